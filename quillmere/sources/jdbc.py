"""Relational tables over JDBC, read in key ranges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from quillmere.functions.joins import skew_join
from quillmere.session import Folder


def jdbc_options(config: dict) -> dict[str, str]:
    """Reader options shared by table and query scans."""
    url = config.get("url") or (
        f"jdbc:{config['type']}://{config['host']}:{config['port']}/{config['database']}"
    )
    options = {"url": url, "fetchsize": str(config.get("chunk_size", 10_000))}
    for ours, theirs in (("username", "user"), ("password", "password"), ("driver", "driver")):
        if config.get(ours):
            options[theirs] = str(config[ours])
    return options


def table_options(config: dict, table: str) -> dict[str, str]:
    """Options of one table scan.  With a partition column the ranges are read
    by parallel tasks; each range is a predicate in the database."""
    options = {**jdbc_options(config), "dbtable": table}
    split = config.get("partitions", {}).get(table)
    if split:
        options |= {
            "partitionColumn": split["column"],
            "lowerBound": str(split["lower"]),
            "upperBound": str(split["upper"]),
            "numPartitions": str(split["count"]),
        }
    return options


def _record(rows: DataFrame, table: str, extracted_at) -> DataFrame:
    return rows.select(
        F.lit(table).alias("table"),
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("data"),
        F.lit(extracted_at).cast("timestamp").alias("extracted_at"),
    )


def _load(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()


def newer_than(rows: DataFrame, column: str, mark) -> DataFrame:
    """Rows strictly past a high-water mark; the filter is pushed into the
    source.  No mark: everything.  For a column whose values are unique and
    grow; where late rows may carry the mark itself, use ``extract_run``."""
    return rows if mark is None else rows.filter(F.col(column) > F.lit(mark))


def high_water_mark(landed: DataFrame, column: str):
    return landed.agg(F.max(column)).first()[0]


def _digest(rows: DataFrame, keys: Sequence[str] | None) -> Column:
    named = F.struct(*(keys or rows.columns))
    return F.sha2(F.to_json(named, {"ignoreNullFields": "false"}), 256)


def from_mark(rows: DataFrame, column: str, mark, seen: DataFrame | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows at the mark or past it, and those without a value in the column,
    less the rows whose digest was ``seen`` there before.  The range is pushed
    into the source; only rows at the mark or without a value have a partner
    in the join."""
    if mark is None and seen is None:
        return rows
    value = F.col(column)
    wanted = rows if mark is None else rows.filter((value >= F.lit(mark)) | value.isNull())
    if seen is None:
        return wanted
    known = seen.select(F.col("digest").alias("_digest")).distinct()
    at_mark = value.isNull() if mark is None else value.isNull() | (value == F.lit(mark))
    told = wanted.withColumn("_digest", F.when(at_mark, _digest(rows, keys)))
    return skew_join(told, known, ["_digest"], "left_anti", spread=rows.columns[:1]).drop("_digest")


def extract_run(rows: DataFrame, column: str, root: str, run: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Land what is new since the last run below ``run`` and return it.

    A row that carries the mark's own value but arrives after its run is new;
    so is one without a value.  Each run keeps its mark with the digests of all
    rows there (of their ``keys``, or of all columns; rows alike in these are
    one), beside what it landed.  A repeated run reads the same state and
    replaces its own folders.  A row below the mark is not looked for.
    """
    spark, states = rows.sparkSession, Folder(rows.sparkSession, f"{root}/marks")
    done = [int(n.removeprefix("run=")) for n in states.names() if n.startswith("run=")]
    before = max((n for n in done if n < run), default=None)
    kind = rows.schema[column].dataType
    shape = T.StructType([T.StructField("digest", T.StringType()), T.StructField("mark", kind)])
    state = None if before is None else spark.read.schema(shape).parquet(f"{root}/marks/run={before}")
    mark = None if state is None else high_water_mark(state, "mark")
    from_mark(rows, column, mark, state, keys).write.mode("overwrite").parquet(f"{root}/rows/run={run}")
    landed = spark.read.schema(rows.schema).parquet(f"{root}/rows/run={run}")
    there = landed.select(_digest(landed, keys).alias("digest"), F.col(column).alias("mark"))
    both = there if state is None else there.unionByName(state)
    last = high_water_mark(both, "mark")
    at_mark = F.col("mark").isNull() if last is None else F.col("mark").isNull() | (F.col("mark") == F.lit(last))
    both.filter(at_mark).distinct().write.mode("overwrite").parquet(f"{root}/marks/run={run}")
    return landed


def scan_table(
    spark: SparkSession, config: dict, table: str, extracted_at, mark=None, state: str | None = None, run: int = 0
) -> DataFrame:
    """Records of a table.  With the ``incremental`` column: those past a
    ``mark``, or, with a ``state`` folder, those that no run before landed."""
    rows = _load(spark, table_options(config, table))
    if config.get("incremental"):
        if state is None:
            rows = newer_than(rows, config["incremental"], mark)
        else:
            rows = extract_run(rows, config["incremental"], f"{state}/{table}", run, config.get("keys", {}).get(table))
    return _record(rows, table, extracted_at)


def scan_query(spark: SparkSession, config: dict, query: str, extracted_at) -> DataFrame:
    rows = _load(spark, {**jdbc_options(config), "query": query})
    return _record(rows, "custom_query", extracted_at)


def scan_database(spark: SparkSession, config: dict, extracted_at) -> DataFrame:
    """The configured query, or the union of the configured tables."""
    if config.get("query"):
        return scan_query(spark, config, config["query"], extracted_at)
    return union_sources([scan_table(spark, config, t, extracted_at) for t in config["tables"]])


def union_sources(parts: Sequence[DataFrame]) -> DataFrame:
    """Union by name; columns missing in a part are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
