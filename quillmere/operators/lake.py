"""Zones of the data lake: writing, reading, catalog, promotion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from quillmere.functions.scalars import before, megabytes
from quillmere.schemas import ASSETS, ZONES
from quillmere.session import written

VERSION = "1.0"
# Days kept per zone and for logs.
RETENTION_DAYS = {"raw": 90, "processed": 180, "curated": 365}
LOG_DAYS = 30


def _check_zone(zone: str) -> None:
    if zone not in ZONES:
        raise ValueError(f"{zone!r} is not a zone of the lake, which has {', '.join(ZONES)}")


def asset_path(root: str, zone: str, key: str) -> str:
    return f"{root.rstrip('/')}/{zone}/{key}"


def _catalog_path(root: str) -> str:
    return f"{root.rstrip('/')}/_assets"


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """The last row of each (zone, key); keys whose last row has no path were
    deleted."""
    rows = spark.read.schema(ASSETS).parquet(_catalog_path(root))
    when = F.struct("created_at", F.col("_metadata.file_modification_time"))
    last = rows.groupBy("zone", "key").agg(F.max_by(F.struct(*[f.name for f in ASSETS]), when).alias("_a"))
    return last.select("_a.*").filter(F.col("path").isNotNull())


def delete_stored(spark: SparkSession, root: str, gone: DataFrame, as_of: datetime) -> int:
    """Delete the files of the given (zone, key) assets and mark them as gone in
    the stored catalog; returns how many there were."""
    there = catalog(spark, root).join(gone.select("zone", "key").distinct(), ["zone", "key"], "left_semi")
    found = written(there, "assets-deleted")
    marks = found.withColumns({"path": F.lit(None).cast("string"), "created_at": F.lit(as_of)})
    marks = marks.select(*[F.col(f.name).cast(f.dataType) for f in ASSETS])
    marks.write.mode("append").parquet(_catalog_path(root))
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    deleted = 0
    for row in found.select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(row["path"])
        path.getFileSystem(conf).delete(path, True)
        deleted += 1
    return deleted


def _register(spark, root, zone, key, fmt, as_of, metadata, tags, source) -> DataFrame:
    """Append the catalog row of a written asset.  Its size comes from the
    file listing; no content is read."""
    path = asset_path(root, zone, key)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    pairs = [F.lit(item) for k, v in (metadata or {}).items() for item in (k, str(v))]
    values = {
        "path": F.lit(path), "zone": F.lit(zone), "key": F.lit(key), "format": F.lit(fmt),
        "size_bytes": F.col("size_bytes"), "created_at": F.lit(as_of), "metadata": F.create_map(*pairs),
        "tags": F.array(*[F.lit(t) for t in tags or []]), "source": F.lit(source), "version": F.lit(VERSION),
    }
    sizes = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes"))
    asset = sizes.select(*[values[f.name].cast(f.dataType).alias(f.name) for f in ASSETS])
    asset.write.mode("append").parquet(_catalog_path(root))
    return asset


def store(
    df: DataFrame, root: str, zone: str, key: str, as_of: datetime, fmt: str = "parquet",
    metadata: dict | None = None, tags: Sequence[str] | None = None, source: str = "unknown",
    max_records: int | None = None,
) -> DataFrame:
    """Write a table (parquet), lines (text) or rows (json) into a zone and
    record the asset; returns its catalog row."""
    _check_zone(zone)
    writer = df.write.format(fmt).mode("overwrite")
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.save(asset_path(root, zone, key))
    return _register(df.sparkSession, root, zone, key, fmt, as_of, metadata, tags, source)


def load(spark: SparkSession, root: str, zone: str, key: str, fmt: str) -> DataFrame:
    """Read an asset by its stored format."""
    _check_zone(zone)
    path = asset_path(root, zone, key)
    if fmt == "text":
        return spark.read.text(path, wholetext=True)
    if fmt in ("parquet", "json"):
        return spark.read.format(fmt).load(path)
    return spark.read.format("binaryFile").load(path)


def land(
    records: DataFrame, root: str, source: str, as_of: datetime, zone: str = "raw", batch_size: int = 1_000_000,
    problems: DataFrame | None = None,
) -> dict:
    """Land connector records in files of at most ``batch_size`` rows.  The rows
    are counted while they are written.  A landing that breaks off gives a
    summary with its error; ``problems`` are the source's own failures."""
    _check_zone(zone)
    failed = problems.count() if problems is not None else 0
    key = f"{source}/{as_of:%Y%m%d_%H%M%S}_batch"
    seen = Observation(f"land-{source}")
    observed = records.observe(seen, F.count(F.lit(1)).alias("rows"))
    path = asset_path(root, zone, key)
    try:
        asset = store(
            observed, root, zone, key, as_of, metadata={"source": source, "ingestion_timestamp": as_of.isoformat()},
            tags=[source, "batch_ingestion"], source=source, max_records=batch_size,
        )
    except PySparkException as problem:
        return {"status": "failed", "records_ingested": 0, "records_failed": failed, "path": path, "error": str(problem)}
    return {
        "status": "completed", "records_ingested": seen.get["rows"], "records_failed": failed, "path": path,
        "asset": asset,
    }


def promote(
    spark: SparkSession, root: str, source_zone: str, target_zone: str, key: str, fmt: str, as_of: datetime,
    transformation: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Read from one zone, transform, write to another."""
    data = load(spark, root, source_zone, key, fmt)
    if transformation is not None:
        data = data.transform(transformation)
    return store(
        data, root, target_zone, key, as_of, fmt, metadata={"promoted_from": source_zone},
        source=f"promotion_from_{source_zone}",
    )


def list_assets(
    assets: DataFrame, zone: str | None = None, prefix: str | None = None, tags: Sequence[str] | None = None
) -> DataFrame:
    """Zone equality, key prefix, any of the tags."""
    if zone:
        assets = assets.filter(F.col("zone") == zone)
    if prefix:
        assets = assets.filter(F.startswith("key", F.lit(prefix)))
    if tags:
        assets = assets.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return assets


def delete_assets(assets: DataFrame, gone: DataFrame) -> DataFrame:
    """Catalog without the given (zone, key) rows."""
    return assets.join(gone.select("zone", "key").distinct(), ["zone", "key"], "left_anti")


def expire_assets(assets: DataFrame, as_of) -> DataFrame:
    """Catalog rows within their zone's retention; other zones are kept."""
    now, cut = F.lit(as_of).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz")
    for zone, days in RETENTION_DAYS.items():
        cut = F.when(F.col("zone") == zone, before(now, days=days)).otherwise(cut)
    return assets.filter(~F.coalesce(F.col("created_at") < cut, F.lit(False)))


def zone_statistics(assets: DataFrame) -> DataFrame:
    """Per zone: assets, bytes, megabytes, counts by format and by source.

    One shuffle on (zone, format, source); the second level sees one row per
    combination.
    """
    combos = assets.groupBy("zone", "format", "source").agg(
        F.count("*").alias("n"), F.sum("size_bytes").alias("bytes")
    )

    def counts(dimension: str):
        return combos.groupBy("zone", dimension).agg(F.sum("n").alias("n")).groupBy("zone").agg(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct(dimension, "n")))).alias(f"{dimension}s")
        )

    totals = combos.groupBy("zone").agg(
        F.sum("n").alias("total_assets"), F.sum("bytes").alias("total_size_bytes")
    )
    return (
        totals.join(counts("format"), "zone")
        .join(counts("source"), "zone")
        .withColumn("total_size_mb", megabytes(F.col("total_size_bytes")))
    )


def ingestion_rate(assets: DataFrame) -> DataFrame:
    """Files per hour by source."""
    return assets.groupBy(F.date_trunc("hour", "created_at").cast("timestamp_ntz").alias("hour"), "source").agg(
        F.count("*").alias("files")
    )


def pass_rate(gated: DataFrame) -> DataFrame:
    """Share of passed quality checks by source."""
    return gated.groupBy("source").agg(
        F.count("*").alias("checked"),
        F.count_if("quality_ok").alias("passed"),
        (F.avg(F.col("quality_ok").cast("double")) * 100).alias("pass_rate_percent"),
    )


def curation_latency(assets: DataFrame) -> DataFrame:
    """Seconds from the first raw to the first curated version of a key.
    Both sides come from one pass over the catalog, so nothing is joined."""
    first = lambda zone: F.min(F.when(F.col("zone") == zone, F.col("created_at")))
    times = assets.filter(F.col("zone").isin("raw", "curated")).groupBy("key").agg(
        first("raw").alias("raw_at"), first("curated").alias("curated_at")
    )
    return times.filter("raw_at is not null and curated_at is not null").withColumn(
        "latency_seconds", F.timestamp_diff("SECOND", F.col("raw_at"), F.col("curated_at"))
    )
