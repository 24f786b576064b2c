"""Static range asymmetric numeral system over interleaved lanes, in numpy.

A block codes whole documents.  Its symbols are dealt in turn to ``LANES``
lanes, each a 64-bit state that takes or gives 32-bit words; all lanes of a
step are one array operation, and their words follow each other in one stream.
Every ``STEPS`` steps the states and the place in the stream are kept as a
checkpoint, from which decoding can start.  Checksums cover the block's bytes
and its symbols.
"""

from __future__ import annotations

import struct
import zlib
from typing import NamedTuple

import numpy as np

LANES = 1024
STEPS = 256  # between checkpoints
_LOW = np.uint64(1 << 31)  # least state
_WORD = np.uint64(32)
_MAGIC = b"QMRANS01"
# magic, bytes after the header, crc32 of them, crc32 of the symbols, part, block, documents, symbols, words, lanes, steps
_HEADER = "<8sQIIqqQQQII"
_HEADER_BYTES = struct.calcsize(_HEADER)


class Frequencies(NamedTuple):
    bits: int
    freq: np.ndarray  # uint64 per symbol, sums to 1 << bits
    below: np.ndarray  # uint64, sum of those before
    symbol: np.ndarray  # uint32 per slot


def frequencies(counts: np.ndarray) -> Frequencies:
    """Counts scaled to a power of two, at least 1 for each symbol that occurs."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    bits = max(16, int(np.ceil(np.log2(4 * len(used) + 1))))
    size = 1 << bits
    freq = np.zeros(len(counts), np.int64)
    if len(used):
        share = counts[used] * ((size - len(used)) / counts[used].sum())
        freq[used] = 1 + share.astype(np.int64)
        freq[used[np.argmax(counts[used])]] += size - freq.sum()
    below = np.cumsum(freq) - freq
    symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)
    return Frequencies(bits, freq.astype(np.uint64), below.astype(np.uint64), symbol)


def _encode(symbols: np.ndarray, table: Frequencies, lanes: int, steps: int):
    n = len(symbols)
    rounds = -(-n // lanes)
    state = np.full(lanes, _LOW, np.uint64)
    bits = np.uint64(table.bits)
    most = (_LOW >> bits) << _WORD
    freq, below = table.freq, table.below
    words, sizes, kept = [], np.zeros(rounds, np.int64), []
    for t in range(rounds - 1, -1, -1):
        s = symbols[t * lanes : (t + 1) * lanes]
        x = state[: len(s)]
        f = freq[s]
        full = x >= most * f
        out = x[full]
        words.append(out.astype(np.uint32))
        sizes[t] = len(out)
        x[full] = out >> _WORD
        q = x // f
        x[:] = (q << bits) + (x - q * f) + below[s]
        if t % steps == 0:
            kept.append(state.copy())
    words.reverse()
    kept.reverse()
    begins = (np.cumsum(sizes) - sizes)[::steps]
    stream = np.concatenate(words) if words else np.empty(0, np.uint32)
    return stream, np.array(kept, np.uint64).reshape(-1, lanes), begins.astype(np.uint64)


def _decode(stream, state, at, first, last, table: Frequencies, lanes: int) -> np.ndarray:
    """Symbols first..last; ``state`` and ``at`` belong to ``first``."""
    out = np.empty(last - first, np.uint32)
    x_all = state.copy()
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    for a in range(0, last - first, lanes):
        m = min(lanes, last - first - a)
        x = x_all[:m]
        slot = x & mask
        s = table.symbol[slot]
        x[:] = table.freq[s] * (x >> bits) + slot - table.below[s]
        need = x < _LOW
        count = int(np.count_nonzero(need))
        x[need] = (x[need] << _WORD) | stream[at : at + count]
        at += count
        out[a : a + m] = s
    return out


def encode_block(
    ids: np.ndarray, doc_ids: list[int | None], sizes: np.ndarray, part: int, number: int, table: Frequencies,
    lanes: int = LANES, steps: int = STEPS,
) -> bytes:
    """Bytes of a block of documents with ``sizes`` ids each."""
    stream, states, begins = _encode(ids, table, lanes, steps)
    body = b"".join([
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.asarray(sizes, "<u8").tobytes(),
        states.astype("<u8").tobytes(), begins.astype("<u8").tobytes(), stream.astype("<u4").tobytes(),
    ])
    checks = zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())
    return struct.pack(
        _HEADER, _MAGIC, len(body), *checks, part, number, len(doc_ids), len(ids), len(stream), lanes, steps
    ) + body


class Block(NamedTuple):
    part: int
    number: int
    doc_ids: list[int | None]
    sizes: np.ndarray
    count: int
    lanes: int
    steps: int
    symbols_crc: int
    states: np.ndarray
    begins: np.ndarray
    stream: np.ndarray

    def segment(self, k: int, table: Frequencies) -> np.ndarray:
        """Symbols from checkpoint ``k`` to the next, without those before."""
        span = self.lanes * self.steps
        first, last = k * span, min((k + 1) * span, self.count)
        return _decode(self.stream, self.states[k], int(self.begins[k]), first, last, table, self.lanes)

    def ids(self, table: Frequencies) -> np.ndarray:
        parts = [self.segment(k, table) for k in range(len(self.states))]
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        if zlib.crc32(ids.astype("<u4").tobytes()) != self.symbols_crc:
            raise ValueError(f"block {self.part}/{self.number}: the decoded ids do not match their checksum")
        return ids


def read_block(data: memoryview, at: int) -> tuple[Block, int]:
    """The block at ``at`` and the place behind it."""
    magic, size, crc, symbols_crc, part, number, docs, count, words, lanes, steps = struct.unpack_from(_HEADER, data, at)
    body = data[at + _HEADER_BYTES : at + _HEADER_BYTES + size]
    if magic != _MAGIC or len(body) != size or zlib.crc32(body) != crc:
        raise ValueError("a block is damaged")
    place = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal place
        got = np.frombuffer(body, kind, n, place)
        place += got.nbytes
        return got

    null, ids, sizes = take("u1", docs), take("<i8", docs), take("<u8", docs)
    marks = -(-count // (lanes * steps))
    states, begins = take("<u8", marks * lanes).reshape(marks, lanes), take("<u8", marks)
    named = [None if x else i for x, i in zip(null.tolist(), ids.tolist())]
    block = Block(part, number, named, sizes.astype(np.int64), count, lanes, steps, symbols_crc, states, begins,
                  take("<u4", words).astype(np.uint64))
    return block, at + _HEADER_BYTES + size
