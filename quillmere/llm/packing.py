"""Best-fit packing of token pieces into sequences of a fixed length.

Bounded-space online best fit: a task keeps at most ``open_bins`` unfinished
sequences in a bitset keyed by free space.  A piece goes where the least room
that holds it is left; if none does, a new sequence opens, and if that is one
too many, the fullest closes.  Memory does not depend on the rows of a task.

Defined cases: a null text is empty and has its end id only; rows with equal
or null ids are documents of their own; an empty table gives an empty result;
only ``doc_id`` and ``text`` are read, other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quillmere.llm.tokens import END, PIECE_BYTES, default_tokenizer, word_ids
from quillmere.llm.words import pieces
from quillmere.session import written

CAPACITY = 4096
OPEN_BINS = 1024
TASK_TOKENS = 32 << 20  # tokens packed by one task


def cut_pieces(
    docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end: int = END, with_ids: bool = False
) -> DataFrame:
    """Token pieces of whole documents: doc_id, piece, start (the document's
    ids before it), length, ids_crc32 and, if asked for, the ids as
    little-endian unsigned 32-bit numbers.  Only documents longer than
    ``capacity`` are cut."""
    path = tokenizer or default_tokenizer()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            ids, starts = word_ids(path).encode(batch.column("text"), end)
            sizes = np.diff(starts)
            count = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = starts[row] + piece * capacity
            last = np.minimum(first + capacity, starts[row + 1])
            raw = memoryview(ids.astype("<u4").tobytes())
            parts = [raw[4 * a : 4 * b] for a, b in zip(first.tolist(), last.tolist())]
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(row)),
                "piece": pa.array(piece.astype(np.int32)),
                "start": pa.array(piece * capacity),
                "length": pa.array(last - first),
                "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


class OpenBins:
    """At most ``most`` open bins in a bitset: bit f is set while a bin has
    f units free."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.open, self.made = 0, 0, 0
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, room: int) -> int:
        bins = self.with_room[room]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << room)
        self.open -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """The bin of a piece and its place there."""
        if length > self.capacity:
            raise ValueError("a piece is longer than a sequence")
        fitting = self.bits >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(room)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            room, chosen = self.capacity, self.made
            self.made += 1
        left = room - length
        if left:
            self.with_room[left].append(chosen)
            self.bits |= 1 << left
            self.open += 1
        return chosen, self.capacity - room


def pack(
    pieces_of: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, task_tokens: int = TASK_TOKENS
) -> DataFrame:
    """``pieces_of`` (doc_id, piece, start, length, ids_crc32) with the
    sequence_id and offset of each piece.

    The pieces are dealt out row by row, whatever their ids, to tasks of about
    ``task_tokens`` tokens.  They come in the order of a hash, which mixes
    lengths and sources, so that a task that is run again packs as before.
    """
    table = written(pieces_of, "pieces")
    total = table.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // task_tokens))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            placed = [bins.place(n) for n in batch.column("length").to_pylist()]
            arrays = np.array(placed, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(arrays[:, 0] + first), pa.array(arrays[:, 1])],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    schema = table.schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"
    mix = F.xxhash64("doc_id", "piece", "ids_crc32")
    order = [mix, "doc_id", "piece", "start", "length", "ids_crc32"]
    return table.repartition(tasks).sortWithinPartitions(*order).mapInArrow(packed, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, **settings) -> DataFrame:
    return pack(cut_pieces(docs, capacity, tokenizer), capacity, **settings)


def sequences(placed: DataFrame) -> DataFrame:
    """Whole sequences of pieces that were cut ``with_ids``: sequence_id, the
    ids of all its pieces in place order, and the pieces' lengths.  A group
    holds at most ``capacity`` ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    grouped = placed.groupBy("sequence_id").agg(parts.alias("p"))
    return grouped.select(
        "sequence_id",
        F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("p", lambda x: x["length"]).alias("lengths"),
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"),
    )
