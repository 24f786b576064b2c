"""Queries over the query log and the stored documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmere.functions import text as tx
from quillmere.functions.scalars import before
from quillmere.operators import analytics, monitoring, quality
from quillmere.plans import snippets as sn
from quillmere.plans.registry import query, stamp, table
from quillmere.session import shared_dir, written

AS_OF = sn.AS_OF


def logs(events: DataFrame) -> DataFrame:
    """The events table read as a query log."""
    kind, value = F.col("event_type"), F.col("value")
    return events.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("props").alias("query_text"),
        F.round(value * 20).cast("long").alias("response_time_ms"),
        F.pmod("user_id", F.lit(6)).alias("num_results"),
        F.when(kind != "error", F.round(F.least(value / 100, F.lit(1.0)), 4)).alias("confidence_score"),
        (kind == "view").alias("cached"),
        F.col("ts").alias("created_at"),
        F.when(kind.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), kind).alias("endpoint"),
        F.when(kind != "error", "200").when(value > 50, "500").otherwise("404").alias("status"),
    )


def query_logs(spark, sf) -> DataFrame:
    return logs(table(spark, sf, "events"))


def stored_documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        "source",
        "lang",
        F.octet_length("text").alias("file_size"),
        F.when(F.col("n_chars") >= 100, "completed").otherwise("pending").alias("status"),
        tx.estimated_chunks(F.col("n_chars")).alias("chunk_count"),
    )


def errors(spark, sf) -> DataFrame:
    failed = table(spark, sf, "events").filter(F.col("event_type") == "error")
    return failed.select(F.variant_get(F.parse_json("props"), "$.k", "string").alias("error_type"), "ts")


@query(f"""SELECT source, count(*) AS document_count, sum(chunk_count)::BIGINT AS total_chunks,
  round(avg(chunk_count), 6) AS avg_chunks_per_doc, sum(file_size)::BIGINT AS total_size_bytes,
  round(avg(file_size), 6) AS avg_size_bytes FROM {sn.STORED} WHERE status = 'completed' GROUP BY source""")
def document_stats(spark, sf):
    stats = analytics.document_stats(stored_documents(spark, sf), by="source")
    return stats.withColumns({c: F.round(c, 6) for c in ("avg_chunks_per_doc", "avg_size_bytes")})


def _hourly_sql() -> str:
    return f"""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, count(*) AS query_count,
      round(avg(response_time_ms), 10) AS avg_response_time, round(avg(confidence_score), 10) AS avg_confidence,
      round(avg(cached::INT) * 100, 10) AS cache_hit_rate FROM {sn.LOGS} GROUP BY 1"""


def hourly_columns(df: DataFrame) -> DataFrame:
    return df.select(
        stamp(F.col("hour")).alias("hour"), "query_count",
        *[F.round(c, 10).alias(c) for c in ("avg_response_time", "avg_confidence", "cache_hit_rate")],
    )


@query(_hourly_sql())
def query_analytics(spark, sf):
    return hourly_columns(analytics.query_analytics(query_logs(spark, sf)))


@query(f"""SELECT (SELECT count(*) FROM {sn.STORED} WHERE status = 'completed') AS total_documents,
  (SELECT sum(chunk_count)::BIGINT FROM {sn.STORED} WHERE status = 'completed') AS total_chunks,
  count(*) AS queries_24h, round(avg(response_time_ms), 6) AS avg_response_time_24h,
  count(DISTINCT user_id) AS active_users_24h, '{AS_OF}' AS last_updated
FROM {sn.LOGS} WHERE created_at > {sn.NOW} - INTERVAL 24 HOUR""")
def dashboard_metrics(spark, sf):
    view = analytics.dashboard_metrics(stored_documents(spark, sf), query_logs(spark, sf), AS_OF)
    return view.withColumns(
        {"avg_response_time_24h": F.round("avg_response_time_24h", 6), "last_updated": stamp(F.col("last_updated"))}
    )


@query(f"""SELECT (SELECT count(*) FROM {sn.STORED} WHERE status = 'completed') AS total_documents,
  (SELECT sum(chunk_count)::BIGINT FROM {sn.STORED} WHERE status = 'completed') AS total_chunks,
  count(*) AS queries_24h, round(avg(response_time_ms), 6) AS avg_response_time_24h,
  count(DISTINCT user_id) AS active_users_24h, '{AS_OF}' AS last_updated
FROM {sn.LOGS} WHERE created_at > {sn.NOW} - INTERVAL 24 HOUR""")
def refreshed_dashboard(spark, sf):
    """The log up to a day before, refreshed; then the day is appended, some
    of it late, with two more refreshes that read what is new."""
    root, logs = shared_dir(spark, "dashboard"), query_logs(spark, sf)
    now = F.lit(AS_OF).cast("timestamp_ntz")
    ago = lambda h: before(now, hours=h)
    at, late = F.col("created_at"), F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0
    steps = [
        (at <= ago(24), ago(24)),
        ((at > ago(24)) & (at <= ago(7)) & ~(late & (at > ago(8))), ago(7)),
        (late & (at > ago(8)) & (at <= ago(7)) | (at > ago(7)), now),
    ]
    documents = written(stored_documents(spark, sf), "stored")
    for where, moment in steps:
        analytics.append_log(logs.filter(where), f"{root}/logs")
        moment = spark.range(1).select(stamp(moment)).first()[0]
        log = spark.read.schema(logs.schema).parquet(f"{root}/logs")
        view = analytics.refresh_dashboard(documents, log, f"{root}/view", moment)
    return view.withColumns(
        {"avg_response_time_24h": F.round("avg_response_time_24h", 6), "last_updated": stamp(F.col("last_updated"))}
    )


_LAST = f"(SELECT * FROM {sn.LOGS} ORDER BY created_at DESC, id DESC LIMIT 1000)"


@query(f"""SELECT count(*) AS total_queries,
  round_even(count(*) / greatest(date_diff('microsecond', min(created_at), {sn.NOW}) / 1e6, 1.0), 2) AS query_rate_per_second,
  round_even(avg(response_time_ms), 2) AS average_processing_time_ms,
  round_even(avg(cached::INT) * 100, 2) AS cache_hit_rate_percent,
  round_even(avg(num_results), 2) AS average_sources_per_query,
  round_even(avg(confidence_score) FILTER (confidence_score > 0), 3) AS average_confidence_score,
  round_even(min(confidence_score) FILTER (confidence_score > 0), 3) AS min_confidence_score,
  round_even(max(confidence_score) FILTER (confidence_score > 0), 3) AS max_confidence_score,
  count(*) FILTER (confidence_score > 0) AS total_confidence_samples FROM {_LAST}""")
def metrics_summary(spark, sf):
    return monitoring.metrics_summary(query_logs(spark, sf), AS_OF)


_ACTIVE = "TIMESTAMP '2024-01-30 23:30:00'"


@query(f"""SELECT count(*) FILTER (h) AS last_hour_queries,
  coalesce(round(avg(response_time_ms) FILTER (h), 6), 0.0) AS last_hour_average_ms,
  count(*) FILTER (m) AS last_minute_queries, round(count(*) FILTER (m) / 60.0, 6) AS last_minute_queries_per_second
FROM (SELECT *, created_at > {_ACTIVE} - INTERVAL 1 HOUR AS h, created_at > {_ACTIVE} - INTERVAL 1 MINUTE AS m FROM {_LAST})""")
def recent_activity(spark, sf):
    activity = monitoring.recent_activity(query_logs(spark, sf), "2024-01-30 23:30:00")
    return activity.withColumns(
        {c: F.round(c, 6) for c in ("last_hour_average_ms", "last_minute_queries_per_second")}
    )


@query(f"""WITH e AS (SELECT count(*) AS n FROM events WHERE event_type = 'error'), q AS (SELECT count(*) AS n FROM {_LAST}),
  r AS (SELECT avg(response_time_ms) AS t, avg((response_time_ms > 5000)::INT) * 100 AS slow
        FROM (SELECT * FROM {_LAST} ORDER BY created_at DESC, id DESC LIMIT 100)),
  x AS (SELECT t, slow, e.n AS total_errors, e.n * 100.0 / greatest(q.n, 1) AS rate FROM e, q, r)
SELECT CASE WHEN rate > 10 THEN 'critical' WHEN rate > 5 OR slow > 20 THEN 'warning' WHEN t > 3000 THEN 'degraded'
       ELSE 'healthy' END AS status, round_even(rate::DOUBLE, 2) AS error_rate_percent,
  round_even(t, 2) AS recent_average_processing_time_ms, round_even(slow, 2) AS slow_query_rate_percent, total_errors FROM x""")
def health_metrics(spark, sf):
    return monitoring.health(query_logs(spark, sf), errors(spark, sf))


@query("SELECT props::JSON ->> '$.k' AS error_type, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1")
def error_counts(spark, sf):
    return monitoring.error_counts(errors(spark, sf))


def _histogram_sql(bounds, by: str = "", seconds: str = "response_time_ms / 1000.0") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}, le" if by else "GROUP BY le"
    les = ", ".join(f"{b}" for b in bounds)
    return f"""SELECT {lead}le, count(*) FILTER (s <= le) AS bucket, count(s) AS count, round(sum(s), 4) AS sum
      FROM (SELECT *, ({seconds})::DOUBLE AS s FROM {sn.LOGS}) CROSS JOIN (SELECT unnest([{les}, 'inf'::DOUBLE]) AS le) {group}"""


@query(" UNION ALL ".join(
    f"SELECT '{n}' AS metric, le::VARCHAR AS le, bucket, count, sum FROM ({_histogram_sql(b)})"
    for n, b in monitoring.HISTOGRAMS.items()
))
def latency_histograms(spark, sf):
    """All four histograms over the response times, in one pass."""
    seconds = F.col("response_time_ms") / 1000.0
    rows = query_logs(spark, sf)
    bounds = sorted({b for bs in monitoring.HISTOGRAMS.values() for b in bs})
    wide = monitoring.histogram(rows, seconds, bounds)
    per = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.array(*[F.lit(float(b)) for b in [*bs, float("inf")]]).alias("les"))
        for n, bs in monitoring.HISTOGRAMS.items()
    ]))
    return wide.select("*", per.alias("h")).filter(F.array_contains("h.les", F.col("le"))).select(
        "h.metric", F.when(F.col("le") == float("inf"), "inf").otherwise(F.col("le").cast("string")).alias("le"),
        "bucket", "count", F.round("sum", 4).alias("sum"),
    )


def _quantile_sql(q: float) -> str:
    return f"""(SELECT method, CASE WHEN le = 'inf'::DOUBLE THEN plow ELSE plow + (le - plow) * ({q} * count - pb) / (bucket - pb) END AS v
      FROM (SELECT *, coalesce(lag(le) OVER w, 0.0) AS plow, coalesce(lag(bucket) OVER w, 0) AS pb FROM buckets WINDOW w AS (PARTITION BY method ORDER BY le))
      WHERE bucket >= {q} * count QUALIFY row_number() OVER (PARTITION BY method ORDER BY le) = 1)"""


@query(f"""WITH buckets AS ({_histogram_sql(monitoring.LONG_BOUNDS, 'method')})
SELECT a.method, round(a.v, 6) AS p50, round(b.v, 6) AS p95 FROM {_quantile_sql(0.5)} a JOIN {_quantile_sql(0.95)} b USING (method)""")
def histogram_quantiles(spark, sf):
    buckets = monitoring.histogram(
        query_logs(spark, sf), F.col("response_time_ms") / 1000.0, monitoring.LONG_BOUNDS, by=["method"]
    )
    return monitoring.histogram_quantiles(buckets, by=["method"]).withColumns(
        {c: F.round(c, 6) for c in ("p50", "p95")}
    )


@query(f"SELECT method, endpoint, status, count(*) AS requests FROM {sn.LOGS} GROUP BY ALL")
def request_counts(spark, sf):
    return monitoring.request_counts(query_logs(spark, sf))


@query(f"""SELECT method, endpoint, count(*) AS requests, round(sum(response_time_ms / 1000.0), 4) AS duration_seconds_sum
FROM {sn.LOGS} GROUP BY ALL""")
def request_durations(spark, sf):
    return monitoring.request_durations(query_logs(spark, sf)).withColumn(
        "duration_seconds_sum", F.round("duration_seconds_sum", 4)
    )


def _rate_sql(source: str = sn.LOGS, by: str = "", step: int = 60) -> str:
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}time_bucket(INTERVAL {step} SECOND, created_at) + INTERVAL 1 SECOND * ({step} * (i + 1)) AS window_end,
      count(*) / 300.0 AS per_second FROM {source} CROSS JOIN range({300 // step}) r(i) GROUP BY ALL"""


def rate_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_end": stamp(F.col("window_end")), "per_second": F.round("per_second", 6)})


_RATE_OUT = "strftime(window_end, '%Y-%m-%d %H:%M:%S') AS window_end, round(per_second, 6)::DOUBLE AS per_second"


@query(f"SELECT {_RATE_OUT} FROM ({_rate_sql()})")
def sliding_query_rate(spark, sf):
    return rate_columns(monitoring.rate(query_logs(spark, sf), slide_seconds=60))


@query(f"SELECT method, endpoint, {_RATE_OUT} FROM ({_rate_sql(by='method, endpoint')})")
def sliding_request_rate(spark, sf):
    return rate_columns(monitoring.rate(query_logs(spark, sf), slide_seconds=60, by=["method", "endpoint"]))


_FAILED = f"(SELECT *, left(status, 1) || 'xx' AS class FROM {sn.LOGS} WHERE status >= '400')"


@query(f"SELECT class, {_RATE_OUT} FROM ({_rate_sql(_FAILED, 'class')})")
def sliding_error_rate(spark, sf):
    failed = query_logs(spark, sf).filter(F.col("status") >= "400")
    classed = failed.withColumn("class", F.concat(F.left("status", F.lit(1)), F.lit("xx")))
    return rate_columns(monitoring.rate(classed, slide_seconds=60, by=["class"]))


@query(f"""SELECT strftime(time_bucket(INTERVAL 300 SECOND, created_at), '%Y-%m-%d %H:%M:%S') AS window_start,
  round(avg(cached::INT) * 100, 6) AS cache_hit_rate FROM {sn.LOGS} GROUP BY 1""")
def cache_hit_rate(spark, sf):
    return monitoring.hit_rate(query_logs(spark, sf)).select(
        stamp(F.col("window_start")).alias("window_start"), F.round("cache_hit_rate", 6).alias("cache_hit_rate")
    )


@query(f"""WITH r AS ({_rate_sql(_FAILED)}), hot AS (SELECT * FROM r WHERE per_second > 0.004)
SELECT {_RATE_OUT} FROM (SELECT *, count(*) OVER (ORDER BY window_end RANGE BETWEEN INTERVAL 120 SECOND PRECEDING AND CURRENT ROW) AS n
  FROM hot) WHERE n = 3""")
def error_rate_alerts(spark, sf):
    failed = query_logs(spark, sf).filter(F.col("status") >= "400")
    rates = monitoring.rate(failed, slide_seconds=60)
    return rate_columns(monitoring.alerts(rates, mark=0.004, held_seconds=120, step_seconds=60))


@query(f"""SELECT count(*) FILTER (created_at >= c) AS kept, count(*) FILTER (created_at < c) AS expired
FROM (SELECT *, {sn.NOW} - INTERVAL 7 DAY AS c FROM {sn.LOGS})""")
def log_retention(spark, sf):
    kept, expired = quality.split_by_age(query_logs(spark, sf), AS_OF, days=7)
    return kept.agg(F.count("*").alias("kept")).select(
        "kept", expired.agg(F.count("*")).scalar().alias("expired")
    )


@query("""SELECT source AS batch_id, count(*) AS total_documents, count(*) FILTER (n_chars >= 200) AS sent_successfully,
  count(*) FILTER (n_chars < 200) AS failed, round(count(*) FILTER (n_chars >= 200) / count(*), 6) AS success_rate
FROM documents GROUP BY source""")
def batch_send_summary(spark, sf):
    sends = table(spark, sf, "documents").select(
        F.col("source").alias("batch_id"), (F.col("n_chars") >= 200).alias("sent")
    )
    return analytics.batch_send_summary(sends).withColumn("success_rate", F.round("success_rate", 6))
