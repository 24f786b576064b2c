"""Document-store collections, read from their newline-delimited exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmere.sources.jdbc import union_sources


def scan_collection(
    spark: SparkSession, root: str, collection: str, equals: dict[str, object] | None = None,
    fmt: str = "json", schema=None,
) -> DataFrame:
    """One collection with an equality filter; ``_id`` becomes a string."""
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema is not None else reader).load(f"{root.rstrip('/')}/{collection}")
    for name, value in (equals or {}).items():
        rows = rows.filter(F.col(name) == F.lit(value))
    if "_id" in rows.columns:
        id_type = rows.schema["_id"].dataType
        plain = F.col("_id.$oid") if "$oid" in getattr(id_type, "names", ()) else F.col("_id")
        rows = rows.withColumn("_id", plain.cast("string"))
    as_json = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return rows.select(F.lit(collection).alias("collection"), as_json.alias("data"))


def scan_collections(
    spark: SparkSession, root: str, collections: Sequence[str], equals: dict[str, object] | None = None,
    fmt: str = "json",
) -> tuple[DataFrame, dict[str, str]]:
    """Union of the readable collections, and why the others were skipped."""
    parts, skipped = [], {}
    for name in collections:
        try:
            parts.append(scan_collection(spark, root, name, equals, fmt))
        except AnalysisException as problem:
            skipped[name] = str(problem).splitlines()[0]
    if not parts:
        return spark.createDataFrame([], "collection string, data string"), skipped
    return union_sources(parts), skipped
