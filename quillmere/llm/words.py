"""Words of whole texts as numbers: one Arrow batch at a time, each distinct
word of a batch handled once in Python, everything per word in Arrow or numpy."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# Bytes of text worked on at once.  A longer text is a piece of its own.
PIECE_BYTES = 8 << 20


def once(name: str, make: Callable[[], object]):
    """``make()`` once per Python worker process, whatever task asks."""
    held = sys.modules.setdefault("_quillmere_held", types.ModuleType("_quillmere_held")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes.astype(np.int64)) - sizes) // limit
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for first, last in zip(bounds, bounds[1:]):
            yield batch.slice(first, last - first)


class Words(NamedTuple):
    codes: np.ndarray  # index of each word in ``distinct``
    starts: np.ndarray  # first word of each text, and the number of words at the end
    distinct: list[str]

    def texts(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))


def split_words(texts: pa.Array) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text; a null text has none."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    distinct = coded.dictionary.to_pylist()
    if "" in distinct:  # white space at an end of a text
        empty = distinct.index("")
        there = codes != empty
        offsets = np.concatenate(([0], np.cumsum(there)))[offsets]
        codes = codes[there]
    return Words(codes, offsets, distinct)


def hashes(words: list[str], seed: int = 0) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass"), seed) for w in words), np.uint64, len(words))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A second hash of 64-bit numbers (a finaliser of multiply and shift)."""
    with np.errstate(over="ignore"):
        x = values ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Polynomial hash of each run of ``size`` neighbours."""
    count = len(values) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = values[:count].copy()
        for k in range(1, size):
            total *= np.uint64(base)
            total += values[k : k + count]
    return total


def ascii_lower(word: str) -> str:
    return word.lower() if word.isascii() else "".join(c.lower() if c < "\x80" else c for c in word)


def in_order(column: pa.Array) -> np.ndarray:
    """Whole numbers of a column; the caller handles nulls by its mask."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64)


def fresh(df, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it new to ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
