"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillmere.session import spread_small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        name = run.__name__
        QUERIES[name] = lambda spark, sf: plain(run(spark, sf))
        if sql:
            SQL[name] = sql
        return run

    return add


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as long, so that both engines agree on the type."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType))]
    return df.withColumns({c: F.col(c).cast("long") for c in ints}) if ints else df


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table that is about to be worked on row by row."""
    return spread_small(table(spark, sf, name))


def stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def entries(mapping: Column) -> Column:
    """A map as sorted "key=value" text."""
    pairs = F.transform(F.map_entries(mapping), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(pairs), ";")
