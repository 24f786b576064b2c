"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from quillmere.session import planned_bytes, setting_bytes

# A key is hot above this share of the rows, so there are at most 1/share.
HOT_SHARE = 1 / 1000


def hot_keys(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows: at most 1/share rows.
    Keys are counted per task before the shuffle."""
    counts = df.groupBy(*on).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n")).scalar()
    return counts.filter(F.col("_n") > total * share).select(*on, F.lit(True).alias("_hot"))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str,
    spread: Sequence[str],
    condition: Column | None = None,
) -> DataFrame:
    """Join ``left`` to a ``right`` that is unique on ``on``.

    A right side below Spark's broadcast threshold is broadcast by Catalyst,
    which moves no left row.  Otherwise the rows of hot left keys are dealt
    out over all shuffle partitions by the ``spread`` columns, and only the
    right rows of those few keys are repeated.  ``condition`` may refer to
    the sides as l and r.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join cannot do a {how} join")
    spark = left.sparkSession
    if planned_bytes(right) <= setting_bytes(spark, "spark.sql.autoBroadcastJoinThreshold"):
        return _join(left, right, list(on), how, condition)
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, on))  # at most 1/HOT_SHARE rows
    deal = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    # null keys match nothing: they are dealt out like a hot key
    alone = reduce(or_, [F.col(k).isNull() for k in on])
    salted = left.join(hot, list(on), "left").withColumn(
        "_salt", F.when(F.col("_hot") | alone, deal).otherwise(F.lit(0))
    ).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, list(on), "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return _join(salted, repeated, [*on, "_salt"], how, condition).drop("_salt")


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str, condition: Column | None) -> DataFrame:
    if condition is None:
        return left.join(right, keys, how)
    matched = condition
    for key in keys:
        matched = matched & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    joined = left.alias("l").join(right.alias("r"), matched, how)
    for key in keys if how in ("inner", "left") else ():
        joined = joined.drop(F.col(f"r.{key}"))
    return joined
