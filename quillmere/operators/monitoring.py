"""Rates, latencies and health from the query log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmere.functions.scalars import before

LAST_QUERIES = 1000
RECENT_QUERIES = 100
SLOW_MS = 5000
DEGRADED_MS = 3000
# Histogram bounds in seconds.
LONG_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0)
SHORT_BOUNDS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0)
HISTOGRAMS = {
    "query": LONG_BOUNDS, "embedding": SHORT_BOUNDS, "vector_search": SHORT_BOUNDS, "generation": LONG_BOUNDS,
}


def last_queries(logs: DataFrame, count: int = LAST_QUERIES) -> DataFrame:
    """The latest queries: a top-n, so each task keeps ``count`` rows."""
    return logs.orderBy(F.desc("created_at"), F.desc("id")).limit(count)


def _seconds(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def metrics_summary(logs: DataFrame, as_of) -> DataFrame:
    """Rate, hit rate, times, sources and confidence of the last 1000."""
    now = F.lit(as_of).cast("timestamp_ntz")
    n = F.count("*")
    span = F.greatest(_seconds(F.min("created_at"), now), F.lit(1.0))
    confident = F.when(F.col("confidence_score") > 0, F.col("confidence_score"))

    def rounded(value: Column, digits: int) -> Column:
        return F.bround(F.coalesce(value, F.lit(0.0)), digits)

    return last_queries(logs).agg(
        n.alias("total_queries"),
        rounded(n / span, 2).alias("query_rate_per_second"),
        rounded(F.avg("response_time_ms"), 2).alias("average_processing_time_ms"),
        rounded(F.avg(F.col("cached").cast("int")) * 100, 2).alias("cache_hit_rate_percent"),
        rounded(F.avg("num_results"), 2).alias("average_sources_per_query"),
        rounded(F.avg(confident), 3).alias("average_confidence_score"),
        rounded(F.min(confident), 3).alias("min_confidence_score"),
        rounded(F.max(confident), 3).alias("max_confidence_score"),
        F.count(confident).alias("total_confidence_samples"),
    )


def recent_activity(logs: DataFrame, as_of) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    hour = F.col("created_at") > before(now, hours=1)
    minute = F.col("created_at") > before(now, mins=1)
    return last_queries(logs).agg(
        F.count_if(hour).alias("last_hour_queries"),
        F.coalesce(F.avg(F.when(hour, F.col("response_time_ms"))), F.lit(0.0)).alias("last_hour_average_ms"),
        F.count_if(minute).alias("last_minute_queries"),
        (F.count_if(minute) / 60.0).alias("last_minute_queries_per_second"),
    )


def error_counts(errors: DataFrame, by: str = "error_type") -> DataFrame:
    return errors.groupBy(by).agg(F.count("*").alias("errors"))


def health(logs: DataFrame, errors: DataFrame) -> DataFrame:
    """Status from the error share and the last 100 response times."""
    total_errors = errors.agg(F.count("*")).scalar()
    queries = last_queries(logs).agg(F.count("*")).scalar()
    recent = last_queries(logs, RECENT_QUERIES).agg(
        F.coalesce(F.avg("response_time_ms"), F.lit(0.0)).alias("avg_ms"),
        F.coalesce(F.avg((F.col("response_time_ms") > SLOW_MS).cast("int")) * 100, F.lit(0.0)).alias("slow"),
    )
    rates = recent.select(
        "avg_ms", "slow", total_errors.alias("total_errors"),
        (total_errors * 100.0 / F.greatest(queries, F.lit(1))).alias("error_rate"),
    )
    return rates.select(
        F.when(F.col("error_rate") > 10, "critical")
        .when((F.col("error_rate") > 5) | (F.col("slow") > 20), "warning")
        .when(F.col("avg_ms") > DEGRADED_MS, "degraded")
        .otherwise("healthy")
        .alias("status"),
        F.bround("error_rate", 2).alias("error_rate_percent"),
        F.bround("avg_ms", 2).alias("recent_average_processing_time_ms"),
        F.bround("slow", 2).alias("slow_query_rate_percent"),
        "total_errors",
    )


def histogram(values: DataFrame, seconds: Column, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative bucket counts (le; infinity last), sum and count.

    All buckets are counted in one pass; the result is turned into rows after
    the aggregate."""
    counts = [F.count_if(seconds <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    wide = values.groupBy(*by).agg(*counts, F.count(seconds).alias("count"), F.sum(seconds).alias("sum"))
    rows = [
        *[F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)],
        F.struct(F.lit(float("inf")).alias("le"), F.col("count").alias("bucket")),
    ]
    return wide.select(*by, "count", "sum", F.explode(F.array(*rows)).alias("_r")).select(
        *by, "_r.le", "_r.bucket", "count", "sum"
    )


def histogram_quantiles(
    buckets: DataFrame, quantiles: Sequence[float] = (0.5, 0.95), by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles by linear interpolation inside the bucket; a quantile in the
    last, open bucket gives the highest bound."""
    per = buckets.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("le", "bucket"))).alias("_b"), F.max("count").alias("_n")
    )

    def value(q: float) -> Column:
        rank = F.lit(q) * F.col("_n")
        at = F.array_position(F.transform("_b", lambda b: b["bucket"] >= rank), F.lit(True)).cast("int")
        this = F.element_at("_b", at)
        prior = F.when(at > 1, F.element_at("_b", F.greatest(at - 1, F.lit(1))))
        low, below = F.coalesce(prior["le"], F.lit(0.0)), F.coalesce(prior["bucket"], F.lit(0))
        share = F.try_divide(rank - below, this["bucket"] - below)
        return F.when(F.col("_n") > 0, F.when(this["le"] == float("inf"), low).otherwise(
            low + (this["le"] - low) * share
        ))

    return per.select(*by, *[value(q).alias(f"p{round(q * 100):02d}") for q in quantiles])


def request_counts(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint", "status").agg(F.count("*").alias("requests"))


def request_durations(requests: DataFrame) -> DataFrame:
    return requests.groupBy("method", "endpoint").agg(
        F.count("*").alias("requests"), F.sum(F.col("response_time_ms") / 1000.0).alias("duration_seconds_sum")
    )


def window_counts(
    df: DataFrame, measures: dict[str, Column], time_col: str = "created_at", width: str = "5 minutes",
    slide: str | None = None, by: Sequence[str] = (),
) -> DataFrame:
    """Aggregates per (sliding) time window; works on batch and on streams
    that carry a watermark."""
    window = F.window(time_col, width, slide)
    aggs = [m.alias(name) for name, m in measures.items()]
    return df.groupBy(window.alias("window"), *by).agg(*aggs).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, *measures
    )


def rate(
    df: DataFrame, time_col: str = "created_at", width_seconds: int = 300, slide_seconds: int = 15,
    by: Sequence[str] = (),
) -> DataFrame:
    """Events per second in a look-back window, sampled every slide.

    Events are first counted per slide (reduced before the shuffle); only
    those counts are repeated into the windows they belong to."""
    slide, width = f"{slide_seconds} seconds", f"{width_seconds} seconds"
    counts = df.groupBy(F.window(time_col, slide).alias("slot"), *by).agg(F.count("*").alias("_n"))
    look_back = F.window(F.window_time("slot"), width, slide).alias("look_back")
    return counts.groupBy(look_back, *by).agg((F.sum("_n") / float(width_seconds)).alias("per_second")).select(
        F.col("look_back.end").alias("window_end"), *by, "per_second"
    )


def hit_rate(df: DataFrame, time_col: str = "created_at", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    share = F.avg(F.col("cached").cast("int")) * 100
    return window_counts(df, {"cache_hit_rate": share}, time_col, width, slide)


def alerts(rates: DataFrame, mark: float, held_seconds: int = 120, step_seconds: int = 15) -> DataFrame:
    """Moments at which the rate has been above ``mark`` at every sample of
    the preceding ``held_seconds``.  A missing sample is a rate of zero.

    Samples are looked up per hour block, each with the lead-in it needs from
    the block before, so no task orders the whole series."""
    steps = held_seconds // step_seconds
    at = F.unix_micros(F.col("window_end").cast("timestamp")) / 1_000_000
    rows = rates.filter(F.col("per_second") > mark).withColumn("_t", at.cast("long"))
    block = F.floor(F.col("_t") / 3600)
    own = rows.withColumns({"_block": block, "_own": F.lit(True)})
    lead = rows.filter(F.floor((F.col("_t") + held_seconds) / 3600) > block).withColumns(
        {"_block": block + 1, "_own": F.lit(False)}
    )
    span = Window.partitionBy("_block").orderBy("_t").rangeBetween(-held_seconds, 0)
    held = own.unionByName(lead).withColumn("_n", F.count("*").over(span))
    return held.filter(F.col("_own") & (F.col("_n") == steps + 1)).select("window_end", "per_second")
