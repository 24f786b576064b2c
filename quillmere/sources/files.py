"""File scans and loading of whole documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quillmere.functions import text as tx
from quillmere.schemas import DOCUMENT_TYPES
from quillmere.session import written

MAX_FILE_BYTES = 50 * 1024 * 1024
TEXT_TYPES = ("txt", "md", "html", "csv")


# A larger file cannot be one value of a row.
MOST_BYTES = (1 << 31) - 1024
TOO_LARGE = "file too large to read"


def _binary(spark: SparkSession, path, limit: int, **options) -> DataFrame:
    """Files with their content; those above ``limit`` keep their row, and their
    content is null and never read.  A file that cannot be read fails the job:
    none is left out in silence."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for name, value in options.items():
        reader = reader.option(name, value)
    found = reader.load(path)
    large = found.filter(F.col("length") > limit).withColumn("content", F.lit(None).cast("binary"))
    return found.filter(F.col("length") <= limit).unionByName(large)


def scan_objects(spark: SparkSession, bucket: str, prefix: str = "", limit: int = MOST_BYTES) -> DataFrame:
    """Objects below ``bucket``/``prefix``: key, size, last_modified, content
    (null above ``limit`` bytes), metadata, source_path.  Columns that are not
    asked for, the content above all, are not read."""
    root = bucket.rstrip("/")
    found = _binary(spark, f"{root}/{prefix}" if prefix else root, limit)
    bare = root.split(":", 1)[-1].lstrip("/") if ":" in root.split("/")[0] else root.lstrip("/")
    at = F.instr(F.col("path"), bare)
    return found.select(
        F.substr(F.col("path"), at + F.lit(len(bare) + 1)).alias("key"),
        F.col("length").alias("size"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"),
        "content",
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.col("path").alias("source_path"),
    )


def scan_directory(
    spark: SparkSession, root: str, patterns: Sequence[str] = ("*",), limit: int = MOST_BYTES
) -> DataFrame:
    """Files below ``root`` whose name matches any of the patterns, each once;
    the content of files above ``limit`` bytes is null and not read."""
    glob = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    found = _binary(spark, root, limit, pathGlobFilter=glob)
    path = F.col("path")
    return found.select(
        path.alias("file_path"),
        tx.file_name(path).alias("file_name"),
        F.col("length").alias("file_size"),
        tx.file_extension(path).alias("file_extension"),
        "content",
        F.col("modificationTime").alias("modified_time"),
    )


def validate_files(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Add file_type, valid and error by size and type."""
    kind = tx.file_type(F.col("file_path"))
    error = F.when(
        F.col("file_size") > limit,
        F.concat(F.lit("File too large: "), F.col("file_size").cast("string"),
                 F.lit(f" bytes (max: {limit})")),
    ).when(
        ~kind.isin(*DOCUMENT_TYPES),
        F.concat(F.lit("Unsupported file type: "), tx.file_extension(F.col("file_path"))),
    )
    return files.withColumns(
        {"filename": tx.file_name(F.col("file_path")), "file_type": kind,
         "valid": error.isNull(), "error": error}
    )


def to_text(kind: Column, name: Column, text: Column) -> Column:
    """Readable text by document type."""
    return (
        F.when(kind == "md", tx.markdown_to_text(text))
        .when(kind == "html", tx.html_to_text(text))
        .when(kind == "csv", tx.csv_digest_text(name, text))
        .otherwise(text)
    )


def load_documents(files: DataFrame, limit: int = MAX_FILE_BYTES) -> DataFrame:
    """Files to documents in one pass: file_path, filename, file_type,
    file_size, content, valid, error.  A file that cannot be read as text
    keeps its row, with the reason; see ``split_rejects``."""
    checked = validate_files(files, limit)
    readable = F.col("file_type").isin(*TEXT_TYPES)
    text = to_text(F.col("file_type"), F.col("filename"), tx.decode_bytes(F.col("content")))
    problem = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(~readable, F.concat(F.lit("no text reader for "), F.col("file_type")))
        .when(F.col("content").isNull(), F.lit("unreadable content"))
    )
    return checked.select(
        "file_path", "filename", "file_type", "file_size",
        F.when(problem.isNull(), text).alias("content"),
        problem.isNull().alias("valid"),
        problem.alias("error"),
    )


def split_rejects(loaded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good documents and the rejects table."""
    return (
        loaded.filter("valid").drop("valid", "error"),
        loaded.filter("not valid").select("file_path", "filename", "file_type", "file_size", "error"),
    )


_SPLITS = (
    "file_path string, block long, quotes long, ended_even long, ended_odd long, lines array<string>"
)


def _csv_splits(lines: DataFrame, sample: int) -> DataFrame:
    """A row per split of a file: its quotes, the records that end in it if it
    begins outside or inside quotes, and its lines as far as the leading
    records need them in either case."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, quotes, ended, kept, enough = None, 0, [0, 0], [], False

        def row() -> pa.RecordBatch:
            values = [at[0]], [at[1]], [quotes], [ended[0]], [ended[1]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(values, (pa.string(), *[pa.int64()] * 4))] + [pa.array([kept], pa.list_(pa.string()))],
                names=["file_path", "block", "quotes", "ended_even", "ended_odd", "lines"])

        for batch in batches:
            files, blocks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("file_path", "block"))
            edges = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if first == last:
                    continue
                if at != (files[first], int(blocks[first])):
                    if at is not None:
                        yield row()
                    at, quotes, ended, kept, enough = (files[first], int(blocks[first])), 0, [0, 0], [], False
                text = batch.column("value").slice(first, last - first)
                own = pc.count_substring(text, '"').to_numpy(zero_copy_only=False).astype(np.int64)
                blank = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
                before = quotes + np.cumsum(own) - own
                ends = [((before + own + p) % 2 == 0) & ~(blank & ((before + p) % 2 == 0)) for p in (0, 1)]
                if not enough:
                    done = np.minimum(*(ended[p] + np.cumsum(ends[p]) for p in (0, 1)))
                    need = int(np.searchsorted(done, sample + 1)) + 1
                    kept += text.slice(0, need).to_pylist()
                    enough = need <= len(text)
                quotes += int(own.sum())
                ended = [ended[p] + int(ends[p].sum()) for p in (0, 1)]
        if at is not None:
            yield row()

    return lines.mapInArrow(read, _SPLITS)


def csv_digest(spark: SparkSession, path: str, sample: int = 10) -> DataFrame:
    """file_path, total_rows and content (as ``text.csv_digest_text`` gives it)
    of CSV files of any size, each with a header of its own.

    The files are read in splits and line breaks inside quotes need no second
    reader: each split is counted for both cases, of beginning outside quotes
    or inside, and the quotes of the splits before it tell which holds.  A row
    per split goes on from there, and of a file's first splits the lines of
    its leading records.  A file without a record has no row.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block"))
    splits = written(_csv_splits(lines, sample), "csv-splits")
    order = Window.partitionBy("file_path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    counted = splits.withColumn("ended", F.when(inside, F.col("ended_odd")).otherwise(F.col("ended_even"))).withColumn(
        "earlier", F.coalesce(F.sum("ended").over(before), F.lit(0)))
    leading = F.when(F.col("earlier") <= sample, F.struct("block", "lines"))
    whole = counted.groupBy("file_path").agg(
        # quotes that stay open make a last record of what is left
        (F.sum("ended") + F.sum("quotes") % 2).alias("records"),
        F.array_sort(F.collect_list(leading)).alias("head"),  # nulls are left out
    ).filter("records > 0")
    text = F.array_join(F.flatten(F.transform("head", lambda h: h["lines"])), "\n")
    return whole.select(
        "file_path", (F.col("records") - 1).alias("total_rows"),
        tx.csv_digest_of(tx.file_name(F.col("file_path")), tx.csv_records(text), F.col("records") - 1, sample).alias("content"),
    )
