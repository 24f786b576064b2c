"""Reports over documents and query logs."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillmere.functions.scalars import before, hour_of
from quillmere.schemas import QUERY_LOGS
from quillmere.session import Folder


def document_stats(documents: DataFrame, by: str = "file_type") -> DataFrame:
    """Completed documents by type."""
    return documents.filter(F.col("status") == "completed").groupBy(by).agg(
        F.count("*").alias("document_count"),
        F.sum("chunk_count").alias("total_chunks"),
        F.avg("chunk_count").alias("avg_chunks_per_doc"),
        F.sum("file_size").alias("total_size_bytes"),
        F.avg("file_size").alias("avg_size_bytes"),
    )


def query_analytics(logs: DataFrame) -> DataFrame:
    """Hourly load, times, confidence and hit rate, latest hour first."""
    return (
        logs.groupBy(hour_of(F.col("created_at")).alias("hour"))
        .agg(
            F.count("*").alias("query_count"),
            F.avg("response_time_ms").alias("avg_response_time"),
            F.avg("confidence_score").alias("avg_confidence"),
            (F.avg(F.col("cached").cast("int")) * 100).alias("cache_hit_rate"),
        )
        .orderBy(F.desc("hour"))
    )


def dashboard_metrics(documents: DataFrame, logs: DataFrame, as_of) -> DataFrame:
    """One row: completed documents, and the last 24 hours of queries.

    One aggregate per table; the document side enters as scalar subquery."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = logs.filter(F.col("created_at") > before(now, hours=24)).agg(
        F.count("*").alias("queries_24h"),
        F.avg("response_time_ms").alias("avg_response_time_24h"),
        F.count_distinct("user_id").alias("active_users_24h"),
    )
    return _with_documents(documents, recent, now)


def _with_documents(documents: DataFrame, recent: DataFrame, now: Column) -> DataFrame:
    done = documents.filter(F.col("status") == "completed").agg(
        F.struct(F.count("*").alias("n"), F.sum("chunk_count").alias("chunks")).alias("d")
    ).scalar()
    return recent.select(
        done["n"].alias("total_documents"),
        done["chunks"].alias("total_chunks"),
        "*",
        now.alias("last_updated"),
    )


def _hour(moment: Column) -> Column:
    return F.date_trunc("hour", moment).cast("timestamp_ntz")


def _states(logs: DataFrame) -> DataFrame:
    """What the dashboard needs of an hour and a user: sums of whole numbers,
    which add up, and the users themselves, which can be told apart later."""
    return logs.groupBy(_hour(F.col("created_at")).alias("hour"), "user_id").agg(
        F.count("*").alias("queries"), F.count("response_time_ms").alias("timed"),
        F.coalesce(F.sum(F.col("response_time_ms").cast("long")), F.lit(0)).alias("milliseconds"),
    )


def refresh_dashboard(documents: DataFrame, logs: DataFrame, path: str, as_of, late_hours: int = 1) -> DataFrame:
    """``dashboard_metrics`` from stored states of the log by hour and user.

    A refresh reads the log from the hour of the refresh before on, and
    ``late_hours`` before that for rows that came late; it writes the states of
    these hours in a folder of its own, beside those it reads later on.  The
    last 24 hours are then added up from the states; of the one hour that they
    cut, the log's rows are read.  A row that comes later than ``late_hours``
    is not looked for.
    """
    spark = logs.sparkSession
    now, form = F.lit(as_of).cast("timestamp_ntz"), "yyyyMMddHH"
    runs = Folder(spark, f"{path}/runs")
    known = sorted((int(n.split("-")[0]), n.split("-")[1], n.split("-")[2]) for n in runs.names())
    start, upto = spark.range(1).select(
        F.date_format(before(now, hours=24), form), F.date_format(before(now, hours=late_hours), form)).first()
    number, since = (known[-1][0] + 1, known[-1][2]) if known else (0, "0")
    fresh = logs if since == "0" else logs.filter(F.col("created_at") >= F.to_timestamp_ntz(F.lit(since), F.lit(form)))
    fresh_states = _states(fresh)
    fresh_states.write.mode("overwrite").parquet(f"{path}/states/run={number}")
    runs.touch(f"{number}-{since}-{upto}")
    # an hour's states are those of the last run that read the hour
    known.append((number, since, upto))
    ends = [k[1] for k in known[1:]] + ["9"]
    hour = F.date_format("hour", form)
    valid = reduce(or_, [
        (F.col("run") == k) & (hour >= since) & (hour < min(ends[i:])) for i, (k, since, _) in enumerate(known)])
    schema = T.StructType([*fresh_states.schema.fields, T.StructField("run", T.IntegerType())])
    states = spark.read.schema(schema).parquet(f"{path}/states").filter(valid & (hour > start)).drop("run")
    first_hour = _hour(before(now, hours=24))
    cut = logs.filter(
        (F.col("created_at") > before(now, hours=24)) & (F.col("created_at") < first_hour + F.make_dt_interval(hours=F.lit(1))))
    both = states.unionByName(_states(cut))
    recent = both.agg(
        F.coalesce(F.sum("queries"), F.lit(0)).alias("queries_24h"),
        F.try_divide(F.sum("milliseconds"), F.sum("timed")).alias("avg_response_time_24h"),
        F.count_distinct("user_id").alias("active_users_24h"),
    )
    return _with_documents(documents, recent, now)


def refresh(view: DataFrame, path: str) -> DataFrame:
    """Write a materialised report and read it back."""
    view.write.mode("overwrite").parquet(path)
    return view.sparkSession.read.schema(view.schema).parquet(path)


def log_rows(responses: DataFrame, as_of) -> DataFrame:
    """Query log rows for responses (request_id, query, cached, and where
    present user_id, response_time_ms, num_sources, confidence_score).  The
    id comes from request and time, so a repeated run gives the same rows."""
    now = F.lit(as_of).cast("timestamp")

    def given(name: str, kind: str, default=None) -> Column:
        present = F.col(name) if name in responses.columns else F.lit(default)
        return present.cast(kind)

    values = {
        "id": F.md5(F.concat_ws("|", F.col("request_id").cast("string"), F.lit(str(as_of))).cast("binary")),
        "user_id": given("user_id", "string"),
        "query_text": F.col("query"),
        "response_time_ms": given("response_time_ms", "int", 0),
        "num_results": given("num_sources", "int", 0),
        "confidence_score": given("confidence_score", "double"),
        "cached": F.col("cached"),
        "created_at": now,
        "ip_address": given("ip_address", "string"),
        "user_agent": given("user_agent", "string"),
    }
    return responses.select(*[values[f.name].alias(f.name) for f in QUERY_LOGS])


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def batch_send_summary(sends: DataFrame) -> DataFrame:
    """Per batch: total, sent, failed and success rate."""
    total, sent = F.count("*"), F.count_if("sent")
    return sends.groupBy("batch_id").agg(
        total.alias("total_documents"),
        sent.alias("sent_successfully"),
        (total - sent).alias("failed"),
        F.coalesce(F.try_divide(sent, total), F.lit(0.0)).alias("success_rate"),
    )


def etl_report(profiles: DataFrame, landed: DataFrame, ingested: DataFrame) -> DataFrame:
    """Stage summaries as one JSON row: tables checked, rows and columns,
    records landed by source, documents and chunks."""
    checked = profiles.agg(
        F.count("*").alias("assets_validated"),
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("column_count"), F.lit(0)).alias("total_columns"),
    )
    # one entry per configured source
    extraction = landed.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "records")))).alias("m")
    ).scalar()
    documents = ingested.agg(
        F.struct(
            F.count_if(F.col("status") == "completed").alias("total_documents_ingested"),
            F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("total_chunks_created"),
        ).alias("s")
    ).scalar()
    return checked.select(
        F.to_json(
            F.struct(
                extraction.alias("extraction_results"),
                F.struct("assets_validated", "total_rows", "total_columns").alias("validation_summary"),
                documents.alias("ingestion"),
                F.lit("completed").alias("run_status"),
            )
        ).alias("report")
    )
