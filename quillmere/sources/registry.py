"""One entry point for all source kinds."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmere.sources import collections, files, jdbc, rest


class Extract(NamedTuple):
    """What a source gave, and what it could not give: source, reason."""

    rows: DataFrame
    problems: DataFrame


def read_source(spark: SparkSession, kind: str, config: dict, extracted_at: datetime | None = None) -> Extract:
    """A configured source of the given kind, with its problems."""
    kind = kind.lower()
    none = spark.createDataFrame([], "source string, reason string")
    if kind in ("s3", "filesystem"):
        if kind == "s3":
            rows, name = files.scan_objects(spark, config["bucket"], config.get("prefix", "")), "key"
        else:
            rows = files.scan_directory(spark, config["root_path"], config.get("file_patterns", ["*"]))
            name = "file_path"
        unread = rows.filter(F.col("content").isNull())
        return Extract(rows, unread.select(F.col(name).alias("source"), F.lit(files.TOO_LARGE).alias("reason")))
    if kind == "database":
        return Extract(jdbc.scan_database(spark, config, extracted_at), none)
    if kind == "api":
        fetch = config.get("fetch") or rest.http_fetcher(
            config["base_url"], config.get("headers"), config.get("params")
        )
        records, errors = rest.scan_endpoints(
            spark, config["endpoints"], fetch, config.get("page_size", 100), config.get("stripes", 1), extracted_at
        )
        where = F.concat(F.col("endpoint"), F.lit(", page "), F.col("page").cast("string"))
        return Extract(records, errors.select(where.alias("source"), F.col("error").alias("reason")))
    if kind == "mongodb":
        rows, skipped = collections.scan_collections(
            spark, config["root_path"], config["collections"], config.get("filter"),
            config.get("format", "json"),
        )
        return Extract(rows, spark.createDataFrame(list(skipped.items()), none.schema))
    raise ValueError(f"unknown source kind: {kind}")
