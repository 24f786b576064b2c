"""Token ids of all documents in binary files, in ascending doc_id order, and
back.  One frequency table, counted over all ids, is shared by all blocks.

``write_tokens`` makes ``path``/frequencies (Parquet, a row per id that occurs)
and ``path``/blocks (binary files of blocks as in ``rans``, each followed by one
line feed; the files' order is that of doc_id).  Both go through Spark's
writers, so any store Spark reaches will do and a lost executor costs its task.

Defined cases: a null text is empty and has its end id only; null ids come
first; rows with equal ids are documents of their own, ordered by their ids'
bytes; an empty table makes no blocks and reads back as no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quillmere.llm.rans import Frequencies, encode_block, frequencies, read_block
from quillmere.llm.tokens import END, PIECE_BYTES, default_tokenizer, word_ids
from quillmere.llm.words import once, pieces
from quillmere.session import written

BLOCK_IDS = 1 << 20  # a block closes with the document that reaches this many
PART_IDS = 16 << 20  # ids of a file, about


def tokenised(docs: DataFrame, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """doc_id, n_tokens, ids: little-endian unsigned numbers of 2 bytes, or 4
    if the vocabulary needs them."""
    path = tokenizer or default_tokenizer()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            own = word_ids(path)
            ids, starts = own.encode(batch.column("text"), end)
            kind = _kind(own.size)
            raw = ids.astype(kind).tobytes()
            width = np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.diff(starts)),
                pa.array([raw[width * a : width * b] for a, b in zip(starts.tolist(), starts[1:].tolist())], pa.binary()),
            ], names=["doc_id", "n_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encoded, "doc_id long, n_tokens long, ids binary")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def _counts(rows: DataFrame, size: int) -> DataFrame:
    """How often each id occurs; a task sends a row per id at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in pieces(batches, "ids"):
            ids = np.frombuffer(b"".join(batch.column("ids").to_pylist()), _kind(size))
            total += np.bincount(ids, minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["id", "n"])

    return rows.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame) -> np.ndarray:
    """Counts by id, on the driver: at most a row per id of the vocabulary."""
    found = counts.toPandas()
    out = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, np.int64)
    out[found["id"].to_numpy(int)] = found["n"].to_numpy(int)
    return out


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, block_ids: int = BLOCK_IDS,
    part_ids: int = PART_IDS,
) -> None:
    file = tokenizer or default_tokenizer()
    rows = written(tokenised(docs, file, end), "token-ids")
    size = word_ids(file).size
    spark = docs.sparkSession
    _counts(rows, size).coalesce(1).write.parquet(f"{path}/frequencies")
    counts = _table(spark.read.parquet(f"{path}/frequencies"))
    parts = max(1, -(-int(counts.sum()) // part_ids))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(f"frequencies {path}", lambda: frequencies(counts))
        part, number = TaskContext.get().partitionId(), 0
        held, doc_ids, sizes, total = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal number, held, doc_ids, sizes, total
            ids = np.frombuffer(b"".join(held), _kind(size)).astype(np.uint32)
            made = encode_block(ids, doc_ids, np.array(sizes), part, number, table)
            number += 1
            held, doc_ids, sizes, total = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["block"])

        for batch in pieces(batches, "ids"):
            for doc, n, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_tokens", "ids"))):
                doc_ids.append(doc)
                sizes.append(n)
                held.append(raw)
                total += n
                if total >= block_ids:
                    yield block()
        if doc_ids:
            yield block()

    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(coded, "block binary").select(F.col("block").cast("string").alias("value"))
    blocks.write.text(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32,
    decoded from the files, with the ids as unsigned 32-bit numbers if asked."""
    counts = _table(spark.read.parquet(f"{path}/frequencies"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: Frequencies = once(f"frequencies {path}", lambda: frequencies(counts))
        for batch in batches:
            for content in batch.column("content"):
                data, at, before = memoryview(content.as_buffer()), 0, 0
                while at < len(data):
                    block, at = read_block(data, at)
                    at += 1  # the line feed
                    raw = memoryview(block.ids(table).astype("<u4").tobytes())
                    ends = np.cumsum(block.sizes)
                    parts = [raw[4 * a : 4 * b] for a, b in zip((ends - block.sizes).tolist(), ends.tolist())]
                    columns = {
                        "part": pa.array([block.part] * len(parts), pa.int64()),
                        "doc_id": pa.array(block.doc_ids, pa.int64()),
                        "before": pa.array(before + ends - block.sizes),
                        "n_tokens": pa.array(block.sizes),
                        "ids_crc32": pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([bytes(p) for p in parts], pa.binary())
                    before += block.count
                    yield pa.RecordBatch.from_pydict(columns)

    schema = "part long, doc_id long, before long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = spark.read.format("binaryFile").load(f"{path}/blocks").select("content")
    rows = written(files.mapInArrow(decoded, schema), "tokens-read")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # a row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    out = rows.join(F.broadcast(base), "part")
    return out.select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )
