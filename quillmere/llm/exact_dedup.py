"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is a run of narrow rows (digest, identity), sorted by
digest.  In each round ``FAN_IN`` neighbouring runs merge into one (run number
divided by the fan-in): per digest the best row and the number of rows are
kept.  After the last round one run holds a row per text.  The result travels
the same tree back down, so every join and every aggregate has at most
``FAN_IN`` rows per (digest, run), and a text that a third of all rows share is
as spread out as its runs are.

A digest alone is not trusted: rows meet only if the SHA-256, the length of
the normalised text and a second, independent 64-bit hash of it agree.

Native DataFrame operations only.

Defined cases: a null text is empty, and all empty texts are equal; among equal
rows the longest original text, then the smallest doc_id (null last), then the
first row of the lowest run stays; a row that occurs twice is kept once; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quillmere.llm.words import fresh
from quillmere.session import written

FAN_IN = 16
SPACE = r"[\x20\x09-\x0D]+"  # deleted before texts are compared
KEY = ["text_sha256", "norm_chars", "check"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def digest_runs(docs: DataFrame, *carry: str) -> DataFrame:
    """One narrow row per document with its run and its place there, sorted by
    digest within the run and written to the shared folder."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("norm", normalised(F.col("text")))
    rows = narrow.select(
        "doc_id",
        F.sha2("norm", 256).alias("text_sha256"),
        F.length("norm").cast("long").alias("norm_chars"),
        F.xxhash64("norm").alias("check"),
        F.length("text").cast("long").alias("chars"),
        F.xxhash64("text").alias("text_hash"),
        F.spark_partition_id().cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )
    return written(rows.sortWithinPartitions(*KEY), "digest-runs")


def _best() -> Column:
    """The smallest of these is the row that stays."""
    return F.struct(
        (-F.col("chars")).alias("less_chars"),
        F.col("doc_id").isNull().alias("no_id"),
        F.col("doc_id").alias("doc_id"),
        F.col("row").alias("row"),
    )


def find_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and further columns, one
    row per document."""
    return _decided(digest_runs(docs))


def _decided(runs: DataFrame) -> DataFrame:
    last = runs.agg(F.max("run")).first()[0] or 0
    level = runs.groupBy(*KEY, "run").agg(F.min(_best()).alias("best"), F.count("*").alias("rows"))
    levels = [written(level, "digest-level")]
    while last > 0:
        last //= FAN_IN
        up = levels[-1].withColumn("run", F.floor(F.col("run") / FAN_IN))
        merged = up.groupBy(*KEY, "run").agg(F.min("best").alias("best"), F.sum("rows").alias("rows"))
        levels.append(written(merged, "digest-level"))
    result = levels.pop()
    for level in reversed(levels):
        own = level.select(*KEY, "run", F.floor(F.col("run") / FAN_IN).alias("parent"))
        above = result.withColumnRenamed("run", "parent")
        result = own.join(above, [*KEY, "parent"]).drop("parent")
    joined = runs.join(result, [*KEY, "run"])
    return joined.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("rows").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256", "chars", "text_hash",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    return kept_rows(docs, written(find_duplicates(docs), "digest-decided"))


def kept_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``decided`` (doc_id, chars, text_hash, kept: a
    row for each) keeps.

    The dropped rows, the smaller side, are anti-joined by doc_id and two
    hashes of the text.  Rows that agree in all of that with a row that stays
    (a row that occurs twice) cannot be told apart by a join; they are set
    aside and one of each, the smallest, is taken.
    """
    names = docs.columns
    key = ["doc_id", "text_hash", "chars"]
    stays = F.sum(F.col("kept").cast("int"))
    twins = decided.groupBy(*key).agg(F.count("*").alias("_n"), stays.alias("_kept")).filter(
        (F.col("_kept") > 0) & (F.col("_n") > F.col("_kept"))
    )
    gone = decided.filter(~F.col("kept")).select(*key).distinct()
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own, others = fresh(docs, "_k0", "_k1", "_k2"), fresh(docs, "_d0", "_d1", "_d2")
    keyed = docs.withColumns(
        dict(zip(own, (F.col("doc_id").cast("long"), F.xxhash64(body), F.length(body).cast("long"))))
    )
    same = reduce(lambda a, b: a & b, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, others)])
    dropped = gone.select([F.col(c).alias(d) for c, d in zip(key, others)])
    single = keyed.join(dropped, same, "left_anti").select(*[F.col(f"`{c}`") for c in names])
    if twins.isEmpty():
        return single
    doubled = twins.select([F.col(c).alias(d) for c, d in zip(key, others)])
    again = keyed.join(doubled, same, "left_semi")
    packed = F.struct(*[F.col(f"`{c}`") for c in names])
    one = again.groupBy(*own).agg(F.min(packed).alias("_row"))
    # a twin that stays is also among the dropped keys, so the two parts are apart
    return single.unionByName(one.select([F.col("_row").getField(c).alias(c) for c in names]))
