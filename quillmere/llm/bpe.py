"""Byte-level BPE of whole texts, and back, by tree concatenation.

A text of at most ``leaf`` code points is encoded in one go, as stretches of
white space and the word behind it: no token lies across such a bound.  A
worker encodes a stretch when it meets it first (``held_ids``); the rest is
array work.  A longer text is cut in halves until every part is short enough; the parts are dealt over all
tasks and encoded there.  Then the parts of a text are joined in pairs, the
pairs in pairs and so on.  Where an unsplit run of the pre-tokenizer goes on
across a join, a window of tokens around it is encoded anew, and doubled until
its first token is the left side's and its last token is the right side's: all
neighbouring tokens are then what BPE gives for them alone, which makes the
whole run what BPE gives for it.

Cuts fall only where the class of the signs on both sides tells whether a run
goes on there (``Codec.goes_on``), never inside an added token such as
``<|endoftext|>``, which is one id as in the tokenizer's own reading.

Defined cases: a null text is empty and has no ids; rows with equal or null
ids are documents of their own; an equal long text is cut and joined once; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, other
columns are ignored.  Ids beyond the vocabulary decode to nothing, and bytes
that are no UTF-8 to U+FFFD, as in the tokenizer's own decoding.  A document's
ids are one value of its row, so a task holds one document's ids at a time.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quillmere.llm.held_ids import HeldIds, gather
from quillmere.llm.words import once, pieces

LEAF = 65_536  # code points encoded in one go, some hundredths of a second's work
BATCH_BYTES = 4 << 20  # text encoded, and ids handed over, at once
JOINT_STRETCHES = 512  # sent to the tokenizer in one text
CUT_BEFORE = " \t\n\r"
# First two UTF-8 bytes of U+1680, U+180E, U+2000 to U+207F, U+3000 and U+FEFF: every further blank is among these rows.
BLANK_LEADS = (0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380, 0xEFBB)
WIDTH = 4  # tokens on each side of a join in the first window
NEAR = 4  # signs around a cut that decide whether it is safe


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself if it prints, else the next from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


def ends_blank(text: str) -> bool:
    """Whether the last sign may count as white space, or joins none."""
    return text[-1].isspace() or text[-1] in "\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"


def stretches_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts cut before each of ``CUT_BEFORE`` that stands behind another
    sign than ASCII white space; the first stretch of each text; and whether a
    stretch may end with a blank that is not ASCII white space."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets -= offsets[0]
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    cut = np.isin(data, np.frombuffer(CUT_BEFORE.encode(), np.uint8))
    cut[1:] &= ~blank[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    places = np.flatnonzero(cut)
    bounds = np.searchsorted(places, offsets)
    ends = np.append(places, len(data)).astype(np.int32)
    last = data[ends[1:] - 1]
    odd = (last >= 0x1C) & (last < 0x20)
    back = lambda k: np.where(ends[1:] >= k, data[np.maximum(ends[1:] - k, 0)], 0)
    odd |= (last >= 0x80) & (back(2) == 0xC2)  # U+0080 to U+00BF
    lead = back(3).astype(np.int64) << 8 | back(2)
    odd |= (last >= 0x80) & np.isin(lead, BLANK_LEADS)
    return pa.StringArray.from_buffers(len(places), pa.py_buffer(ends), pa.py_buffer(data)), bounds, odd


class Part(NamedTuple):
    """Ids of a stretch of text, and how many belong to its first and last unsplit run."""

    ids: np.ndarray
    head: int
    tail: int


class Codec:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.signs = [""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.signs[k] = token
        byte = {s: b for b, s in enumerate(byte_signs())}
        spelt = [
            bytes(map(byte.__getitem__, t)) if all(s in byte for s in t) else t.encode() for t in self.signs
        ]
        self.flat = np.frombuffer(b"".join(spelt), np.uint8)
        self.ends = np.cumsum([0, *map(len, spelt)])
        self.sizes = np.diff(self.ends)
        self.kinds: dict[str, str] = {}
        self.held = HeldIds(self._stretch_ids)

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        return [np.array(e.ids, np.uint32) for e in found]

    def _stretch_ids(self, stretches: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The stretches with their ids.  Those of white space and a word are
        sent many in one text and parted by their bytes."""
        joint, rest = [], []
        for s in stretches:
            last = s[-1]
            plain = s[0] in CUT_BEFORE and (" " < last < "\x7f" or not ends_blank(s))
            (joint if plain else rest).append(s)
        ids, sizes = [], []
        bytes_of = pc.binary_length(pa.array(joint, pa.string())).to_numpy(zero_copy_only=False)
        places = range(0, len(joint), JOINT_STRETCHES)
        for at, found in zip(places, self._batch(["".join(joint[k : k + JOINT_STRETCHES]) for k in places])):
            last = np.cumsum(bytes_of[at : at + JOINT_STRETCHES])
            ids.append(found)
            sizes.append(np.diff(np.searchsorted(np.cumsum(self.sizes[found]), last) + 1, prepend=0))
        alone = self._batch(rest)
        return joint + rest, np.concatenate([*ids, *alone]), np.concatenate([*sizes, np.fromiter(map(len, alone), np.int64, len(alone))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        stretches, bounds, odd = stretches_of(texts)
        coded = stretches.dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        first, count = self.held.spans(distinct)
        sizes = count[codes]
        ids = gather(self.held.flat, first[codes], sizes)
        starts = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        # behind a blank that is not ASCII the bound of a stretch may lie in a row of blanks
        unsure = np.flatnonzero(odd)
        if not len(unsure):
            return ids, starts
        text = np.unique(np.searchsorted(bounds, unsure, "right") - 1)
        parts = np.split(ids, starts[1:-1])
        for k, found in zip(text.tolist(), self._batch(texts.take(pa.array(text)).to_pylist())):
            parts[k] = found
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        ids = ids[ids < len(self.signs)]
        return gather(self.flat, self.ends[ids], self.sizes[ids]).tobytes()

    def texts(self, rows: pa.Array) -> pa.Array:
        """The text of each row of ids."""
        ids = np.frombuffer(b"".join(rows.to_pylist()), "<u4")
        bounds = np.concatenate(([0], np.cumsum(pc.binary_length(rows).to_numpy(zero_copy_only=False) // 4)))
        sizes = np.append(self.sizes, 0)[np.minimum(ids, len(self.signs))]
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        data = self.decode(ids)
        whole = pa.StringArray.from_buffers(len(rows), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
        try:
            whole.validate(full=True)
        except pa.ArrowInvalid:  # not UTF-8
            return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])], pa.string())
        return whole

    # Where to cut

    def kind(self, sign: str) -> str:
        """Class of a sign, asked of the pre-tokenizer: letter, number, space or other."""
        found = self.kinds.get(sign)
        if found is None:
            alone = lambda probe: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(probe + sign)) == 1
            found = "letter" if alone("a") else "number" if alone("1") else "space" if alone("\n") else "other"
            self.kinds[sign] = found
        return found

    def goes_on(self, text: str, at: int) -> bool | None:
        """Whether a run goes on across a cut before ``text[at]``; None if the
        cut is not safe.  Runs are of letters, numbers, spaces or other signs;
        a space may begin a run of another class, the last space of a row
        stands apart, and an apostrophe may take up to two letters."""
        first = max(0, at - NEAR - max(map(len, self.added), default=0))
        for token in self.added:
            begin = text.find(token, first, at + NEAR + len(token))
            while begin >= 0:
                end = begin + len(token)
                if at in (begin, end):
                    return False
                if begin < at + NEAR and end > at - NEAR:
                    return None
                begin = text.find(token, end, at + NEAR + len(token))
        before, after = self.kind(text[at - 1]), self.kind(text[at])
        following = self.kind(text[at + 1]) if at + 1 < len(text) else None
        if before == "space" and after != "space":
            return None
        if after == "letter" and "'" in text[max(0, at - 3) : at]:
            return None
        if text[at] == "'" and before == "other" and following == "letter":
            return None
        if before == after == "space":
            return following in ("space", None)
        return before == after

    def halves(self, text: str, leaf: int) -> list[tuple[int, int, bool]]:
        """(begin, end, whether a run goes on into it) of each part."""
        done, waiting = [], [(0, len(text), False)]
        while waiting:
            begin, end, joined = waiting.pop()
            cut = self.middle(text, begin, end) if end - begin > leaf else None
            if cut is None:
                done.append((begin, end, joined))
            else:
                waiting += [(cut[0], end, cut[1]), (begin, cut[0], joined)]
        return done

    def middle(self, text: str, begin: int, end: int) -> tuple[int, bool] | None:
        """The safe cut nearest to the middle, and whether a run goes on there."""
        centre = (begin + end) // 2
        for step in range((end - begin) // 2):
            for at in {centre - step, centre + step}:
                if begin < at < end and (joined := self.goes_on(text, at)) is not None:
                    return at, joined
        return None

    # Parts and their joins

    def part(self, text: str) -> Part:
        found = self.tokenizer.encode(text, add_special_tokens=False)
        run = np.array(found.word_ids, np.int64)
        ids = np.array(found.ids, np.uint32)
        inner = np.flatnonzero(np.diff(run)) + 1
        return Part(ids, int(inner[0]) if len(inner) else len(ids), len(ids) - (int(inner[-1]) if len(inner) else 0))

    def run(self, ids: list[int]) -> list[int]:
        """BPE of the signs of ``ids`` as one unsplit run."""
        return [t.id for t in self.model.tokenize("".join([self.signs[k] for k in ids]))]

    def joined_run(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        width = WIDTH
        while True:
            first, last = max(0, len(left) - width), min(len(right), width)
            window = self.run([*left[first:].tolist(), *right[:last].tolist()])
            agrees = first == 0 or window[0] == left[first]
            if agrees and (last == len(right) or window[-1] == right[last - 1]):
                return np.concatenate((left[:first], np.array(window, np.uint32), right[last:]))
            width *= 2

    def join(self, a: Part, b: Part, goes_on: bool) -> Part:
        if not goes_on:
            return Part(np.concatenate((a.ids, b.ids)), a.head, b.tail)
        outer, inner = a.ids[: len(a.ids) - a.tail], b.ids[b.head :]
        run = self.joined_run(a.ids[len(outer) :], b.ids[: b.head])
        head = a.head if len(outer) else len(run)
        tail = b.tail if len(inner) else len(run)
        return Part(np.concatenate((outer, run, inner)), head, tail)


class Tree:
    """Parts of one text, joined in pairs of equal height as they come."""

    def __init__(self, codec: Codec):
        self.codec, self.nodes = codec, []

    def add(self, part: Part, goes_on: bool) -> None:
        self.nodes.append((0, part, goes_on))
        while len(self.nodes) > 1 and self.nodes[-1][0] == self.nodes[-2][0]:
            self._join()

    def _join(self) -> None:
        (height, a, before), (_, b, between) = self.nodes[-2:]
        self.nodes[-2:] = [(height + 1, self.codec.join(a, b, between), before)]

    def whole(self) -> np.ndarray:
        while len(self.nodes) > 1:
            self._join()
        return self.nodes[0][1].ids


def codec(path: str) -> Codec:
    return once(f"bpe {path}", lambda: Codec(path))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.astype("<u4").tobytes() for a in arrays], pa.binary())


def _rows(ids: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Stretches of ``ids`` as binary values."""
    return pa.Array.from_buffers(
        pa.binary(), len(starts) - 1, [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


def encode(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF) -> DataFrame:
    """doc_id and token_ids, little-endian unsigned 32-bit numbers, of every
    document; no special tokens are added."""
    path = tokenizer or default_tokenizer()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            ids = _rows(*codec(path).encode(batch.column("text")))
            yield pa.record_batch([batch.column("doc_id"), ids], ["doc_id", "token_ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text").to_pylist()):
                parts = codec(path).halves(text, leaf)
                yield pa.record_batch({
                    "digest": pa.array([digest] * len(parts)), "part": pa.array(range(len(parts)), pa.int32()),
                    "goes_on": [p[2] for p in parts], "text": [text[p[0] : p[1]] for p in parts],
                })

    def encode_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", BATCH_BYTES):
            found = [codec(path).part(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "digest": batch.column("digest"), "part": batch.column("part"), "goes_on": batch.column("goes_on"),
                "head": pa.array([p.head for p in found], pa.int64()), "tail": pa.array([p.tail for p in found], pa.int64()),
                "ids": _binary([p.ids for p in found]),
            })

    def join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = lambda: pa.record_batch([pa.array([now]), _binary([tree.whole()])], ["digest", "token_ids"])
        now, tree = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["digest"] != now:
                    if tree:
                        yield done()
                    now, tree = r["digest"], Tree(codec(path))
                tree.add(Part(np.frombuffer(r["ids"], "<u4"), r["head"], r["tail"]), r["goes_on"])
        if tree:
            yield done()

    short = rows.filter(F.length("text") <= leaf).mapInArrow(whole, f"doc_id {kind}, token_ids binary")
    long = rows.filter(F.length("text") > leaf).withColumn("digest", F.sha2("text", 256))
    # equal parts of equal texts fall together in their task before they are dealt out
    parts = long.select("digest", "text").mapInArrow(
        cut, "digest string, part int, goes_on boolean, text string"
    ).dropDuplicates(["digest", "part"])
    ids = parts.mapInArrow(
        encode_parts, "digest string, part int, goes_on boolean, head long, tail long, ids binary"
    ).repartition("digest").sortWithinPartitions("digest", "part").mapInArrow(
        join_parts, "digest string, token_ids binary"
    )
    return short.unionByName(long.select("doc_id", "digest").join(ids, "digest").select("doc_id", "token_ids"))


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The rows of ``encode`` with their text, special tokens included."""
    path = tokenizer or default_tokenizer()
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "token_ids", BATCH_BYTES):
            ids = pc.fill_null(batch.column("token_ids"), b"")
            yield batch.append_column("text", codec(path).texts(ids))

    return encoded.select("doc_id", "token_ids").mapInArrow(texts, f"doc_id {kind}, token_ids binary, text string")
