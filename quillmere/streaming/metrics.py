"""Query-log metrics on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.operators import monitoring

LATENESS = "10 minutes"


def with_watermark(logs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Watermarks need a zoned timestamp; the log's times are UTC."""
    return logs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", lateness)


def hourly_analytics(logs: DataFrame, lateness: str = LATENESS) -> DataFrame:
    measures = {
        "query_count": F.count("*"),
        "avg_response_time": F.avg("response_time_ms"),
        "avg_confidence": F.avg("confidence_score"),
        "cache_hit_rate": F.avg(F.col("cached").cast("int")) * 100,
    }
    return monitoring.window_counts(with_watermark(logs, lateness), measures, width="1 hour").withColumnRenamed(
        "window_start", "hour"
    )


def sliding_rate(logs: DataFrame, lateness: str = LATENESS, **options) -> DataFrame:
    return monitoring.rate(with_watermark(logs, lateness), **options)


def run_to_end(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the closed windows of a finite stream to Parquet files."""
    query = (
        df.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def _run(df: DataFrame, path: str, checkpoint: str, mode: str) -> StreamingQuery:
    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def run_complete(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a small report up to date: each micro-batch writes the full result
    in a folder of its own number."""
    return _run(df, path, checkpoint, "complete")


def run_updates(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes only the rows it changed."""
    return _run(df, path, checkpoint, "update")


def last_update(updates: DataFrame, key: str) -> DataFrame:
    """Current rows of a table written by ``run_updates``."""
    columns = [c for c in updates.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*columns), "batch")
    return updates.groupBy(key).agg(last.alias("_row")).select(key, "_row.*")
