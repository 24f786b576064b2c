"""The chunk table under create, replace and delete.

Plain Parquet, append only, cut into hash buckets of the document id.  Every
change has a version that the store gives out for a writer and its batch
number; the same writer and batch get the same version again.  A change writes
only its own ``version``/``writer`` folder, so a repeated batch replaces its own
rows, no writer can touch another's, and readers never meet a half-written
file.  A deletion is a row in ``removed``; it hides the document's chunks of
earlier versions.

Whatever asks for some documents (a removal, a replacement, a look-up) reads
the buckets of these documents alone: their numbers become a partition filter.
"""

from __future__ import annotations

import random
import re
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillmere.functions.joins import skew_join
from quillmere.functions.scalars import merge_maps
from quillmere.schemas import CHUNKS
from quillmere.session import Folder

REMOVED = T.StructType([T.StructField("document_id", T.StringType())])
CHANGES = T.StructType(
    [T.StructField("document_id", T.StringType()), T.StructField("key", T.StringType()),
     T.StructField("value", T.StringType()), T.StructField("sequence", T.StringType())]
)
TABLES = {"chunks": CHUNKS, "removed": REMOVED, "metadata": CHANGES}
# Choose as many as make a bucket a few GB; ``compact`` can change it.
BUCKETS = 16

PLACE = [T.StructField("version", T.LongType()), T.StructField("writer", T.StringType()), T.StructField("bucket", T.IntegerType())]


class Change(NamedTuple):
    """A change's place in the store."""

    version: int
    writer: str

    def folder(self, path: str, table: str) -> str:
        return f"{path}/{table}/version={self.version}/writer={self.writer}"


def bucket_of(document_id: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def bucket_count(spark: SparkSession, path: str) -> int:
    return min(map(int, Folder(spark, f"{path}/layout").names()))


def _write(df: DataFrame, path: str, table: str, change: Change) -> None:
    """Rows by bucket, large buckets in several files."""
    names = [f.name for f in TABLES[table]]
    placed = df.select(*names, bucket_of("document_id", bucket_count(df.sparkSession, path)).alias("bucket"))
    placed.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(change.folder(path, table))


def create(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """Empty tables at version 0.  A store that is there is left as it is."""
    layout = Folder(spark, f"{path}/layout")
    if not layout.names():
        layout.touch(str(buckets))
    start = Change(0, "store")
    for table, schema in TABLES.items():
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        empty = spark.range(0, 0, 1, 1).select(*none)
        empty.write.mode("ignore").parquet(f"{start.folder(path, table)}/bucket=0")


def begin(spark: SparkSession, path: str, writer: str, batch: int = 0) -> Change:
    """The place of a writer's batch: the one it had before, or a new version.
    Give each writer a name of its own; a stream's is its query id, which a new
    checkpoint changes.

    A number is claimed by a file of one's own in the number's folder.  It is
    ours only if a listing after that shows no other claim; two that claim at
    once may both see the other and go on, but never both see themselves alone.
    """
    name = re.sub("[^A-Za-z0-9_.-]", "_", writer) + f"-{batch}"
    claims, mine = Folder(spark, f"{path}/claims"), Folder(spark, f"{path}/owners/{name}")
    while not mine.names():
        number = max(map(int, claims.names()), default=0) + 1
        claim = uuid.uuid4().hex
        claims.touch(f"{number}/{claim}")
        if claims.names(str(number)) == [claim]:
            mine.touch(str(number))
        else:
            time.sleep(random.random() / 10)
    return Change(min(map(int, mine.names())), name)


def _read(spark: SparkSession, path: str, table: str, buckets: list[int] | None = None) -> DataFrame:
    schema = T.StructType([*TABLES[table].fields, *PLACE])
    rows = spark.read.schema(schema).parquet(f"{path}/{table}").drop("writer")
    return rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))


def buckets_of(documents: DataFrame, path: str) -> list[int]:
    """The buckets that hold the documents: at most as many numbers as the
    store has buckets reach the driver."""
    count = bucket_count(documents.sparkSession, path)
    found = documents.agg(F.collect_set(bucket_of("document_id", count))).first()[0]
    return sorted(found)


def insert(chunks: DataFrame, path: str, change: Change) -> DataFrame:
    """Append chunks; returns their ids."""
    _write(chunks, path, "chunks", change)
    return chunks.sparkSession.read.schema(CHUNKS).parquet(change.folder(path, "chunks")).select("id")


def known_documents(documents: DataFrame, path: str, before: int | None = None) -> DataFrame:
    """Those of the documents that the store has met (before a version).  The
    store's side is the id column of their buckets, and the documents are the
    side that Catalyst may broadcast."""
    asked = documents.select("document_id").distinct()
    buckets = buckets_of(asked, path)
    ids = [_read(asked.sparkSession, path, table, buckets) for table in ("chunks", "metadata")]
    if before is not None:
        ids = [t.filter(F.col("version") < before) for t in ids]
    met = ids[0].select("document_id").unionByName(ids[1].select("document_id"))
    return met.join(asked, "document_id", "left_semi").distinct()


def remove(documents: DataFrame, path: str, change: Change) -> None:
    """Hide all chunks of the documents written before the change.  Documents
    the store has never had need no row: a new document's creation adds none."""
    _write(known_documents(documents, path, change.version), path, "removed", change)


def replace(chunks: DataFrame, documents: DataFrame, path: str, change: Change) -> None:
    """New content for the documents: old chunks go, the given ones come."""
    remove(documents, path, change)
    _write(chunks, path, "chunks", change)


def change_metadata(changes: DataFrame, path: str, change: Change) -> None:
    """Record metadata changes: document_id, metadata map, sequence (a string
    that sorts in event order)."""
    rows = changes.select("document_id", F.explode("metadata").alias("key", "value"), "sequence")
    _write(rows, path, "metadata", change)


def current(
    spark: SparkSession, path: str, with_changes: bool = True, documents: DataFrame | None = None
) -> DataFrame:
    """The visible chunks, metadata changes applied: of the whole store, or of
    the given documents, for which only their buckets are read."""
    buckets = None
    read = lambda table: _read(spark, path, table, buckets)
    if documents is not None:
        asked = documents.select("document_id").distinct()
        buckets = buckets_of(asked, path)
        read = lambda table: _read(spark, path, table, buckets).join(asked, "document_id", "left_semi")
    chunks = read("chunks").drop("bucket")
    removed = read("removed").groupBy("document_id").agg(F.max("version").alias("version"))
    live = skew_join(
        chunks, removed, ["document_id"], "left_anti", spread=["id"],
        condition=F.col("l.version") < F.col("r.version"),
    )
    if not with_changes:
        return live
    # last writer per document and key, reduced before the shuffle; if even
    # that is older than the document's last removal, it is about content
    # that is gone
    latest = read("metadata").groupBy("document_id", "key").agg(
        F.max_by(F.struct("value", "version"), F.struct("version", "sequence")).alias("_last")
    )
    latest = latest.select("document_id", "key", "_last.*").join(
        removed.withColumnRenamed("version", "_removed"), "document_id", "left"
    ).filter(F.col("_removed").isNull() | (F.col("version") >= F.col("_removed")))
    overlay = latest.groupBy("document_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_changes")
    )
    joined = skew_join(live, overlay, ["document_id"], "left", spread=["id"])
    return joined.withColumn(
        "metadata",
        F.when(F.col("_changes").isNull(), F.col("metadata")).otherwise(merge_maps(F.col("metadata"), F.col("_changes"))),
    ).drop("_changes")


def deleted_counts(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks each given document would lose; 0 for unknown documents."""
    wanted = documents.select("document_id").distinct()
    counts = chunks.join(wanted, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("deleted"))
    return wanted.join(counts, "document_id", "left").withColumn(
        "deleted", F.coalesce("deleted", F.lit(0))
    )


def stored_counts(documents: DataFrame, path: str) -> DataFrame:
    """Visible chunks of each given document, from its bucket alone."""
    return deleted_counts(current(documents.sparkSession, path, False, documents), documents)


def compact(spark: SparkSession, path: str, target: str, buckets: int | None = None) -> None:
    """Write the visible chunks to a new store at ``target``, with another
    number of buckets if asked; its readers switch by using that path, and its
    next change comes after them."""
    create(spark, target, buckets or bucket_count(spark, path))
    _write(current(spark, path), target, "chunks", begin(spark, target, "compact"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total_entities"),
        F.count_distinct("document_id").alias("total_documents"),
        F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("total_size_bytes"),
    )
