"""Cleaning of landed tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window, functions as F, types as T

from quillmere.functions import text as tx
from quillmere.session import written


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Whole-row de-duplication; copies are merged before the shuffle.  Map
    columns, which cannot be grouped, take part as JSON."""
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if not maps:
        return df.dropDuplicates()
    keyed = df.withColumns({f"_k_{c}": F.to_json(F.array_sort(F.map_entries(c))) for c in maps})
    keys = [f"_k_{c}" if c in maps else c for c in df.columns]
    return keyed.dropDuplicates(keys).select(df.columns)


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Interpolated medians of any number of values, all columns together.

    Values are counted per task, dealt out by range and written; the counts of
    the ranges (a row per range and column) tell in which one the middle lies,
    and only that one is sorted.
    """
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    values = df.select(F.inline(cells)).filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"))
    ranges = written(values.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()), "median")
    sizes = ranges.groupBy("c", "part").agg(F.sum("n").alias("n")).orderBy("c", "part").collect()
    wanted: dict[int, list[tuple[int, int]]] = {}  # column: (range, rank in it) of the middle values
    for c in range(len(columns)):
        own = [(r["part"], r["n"]) for r in sizes if r["c"] == c]
        total = sum(n for _, n in own)
        for rank in sorted({(total - 1) // 2, total // 2} if total else ()):
            for part, n in own:
                if rank < n:
                    wanted.setdefault(c, []).append((part, rank))
                    break
                rank -= n
    if not wanted:
        return dict.fromkeys(columns)
    up_to = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v"))
    here = reduce(or_, [(F.col("c") == c) & (F.col("part") == p) for c, spots in wanted.items() for p, _ in spots])
    rows = ranges.filter(here).withColumn("last", up_to)
    hit = [
        (F.col("c") == c) & (F.col("part") == p) & (F.col("last") > r) & (F.col("last") - F.col("n") <= r)
        for c, spots in wanted.items() for p, r in spots
    ]
    middle: dict[int, list[float]] = {}
    for row in rows.filter(reduce(or_, hit)).select("c", "v").collect():  # two a column at most
        middle.setdefault(row["c"], []).append(row["v"])
    return {name: sum(m) / len(m) if (m := middle.get(c)) else None for c, name in enumerate(columns)}


def exact_median(df: DataFrame, column: str) -> float | None:
    return exact_medians(df, [column])[column]


def fill_numeric_with_median(
    df: DataFrame, columns: list[str] | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Nulls to the column's median.  Columns without nulls or without values,
    and ``keys``, stay as they are; a whole-number column stays one if its
    median is whole, and becomes double if not."""
    names = [c for c in (numeric_columns(df) if columns is None else columns) if c not in keys]
    if not names:
        return df
    source = written(df, "filled")
    holes = source.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
    medians = exact_medians(source, [c for c in names if holes[c]])
    filled = {}
    for name, middle in medians.items():
        kind = source.schema[name].dataType
        if middle is None:
            continue
        if isinstance(kind, T.IntegralType) and not float(middle).is_integer():
            kind = T.DoubleType()
        filled[name] = F.coalesce(F.col(name).cast(kind), F.lit(middle).cast(kind))
    return source.withColumns(filled) if filled else source


def fill_text_with_empty(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return df.fillna("", subset=text_columns(df) if columns is None else columns)


def standardise_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    names = text_columns(df) if columns is None else columns
    return df.withColumns({c: tx.lower_strip(F.col(c)) for c in names})


def process_table(df: DataFrame, processed_at: datetime | str, keys: Sequence[str] = ()) -> DataFrame:
    """De-duplicate, fill numbers (but not ``keys``) with the median and text
    with '', standardise the text, stamp the rows."""
    return (
        df.transform(drop_duplicate_rows)
        .transform(fill_numeric_with_median, keys=keys)
        .transform(fill_text_with_empty)
        .transform(standardise_columns)
        .withColumn("processed_at", F.lit(str(processed_at)))
    )


def drop_duplicate_content(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Keep the lowest id of each normalised text.

    Digests are reduced before the shuffle, so a text copied over a third of
    the table is one row per task.  The rows that go, the smaller side, are
    taken out by id; Spark broadcasts them when they are few.
    """
    digest = F.sha2(tx.standardise_text(F.col(text_col)).cast("binary"), 256)
    narrow = written(df.select(F.col(id_col).alias("_id"), digest.alias("_digest")), "content-digests")
    groups = narrow.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    gone = narrow.join(groups, "_digest").filter(~F.col("_id").eqNullSafe(F.col("_first"))).select(F.col("_id").alias(id_col))
    return df.join(gone.distinct(), id_col, "left_anti")
