"""Sources to raw, processed and curated zones to stored chunks, as one job.
Each stage writes its zone table and the next one reads it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmere.operators import chunk_store, lake
from quillmere.operators.analytics import etl_report
from quillmere.operators.chunking import packed_windows
from quillmere.operators.cleaning import process_table
from quillmere.operators.curation import curate_rows, ingestion_requests
from quillmere.operators.ingestion import ingestion_responses, request_chunks
from quillmere.operators.quality import profile_tables
from quillmere.session import written
from quillmere.sources.jdbc import union_sources


def run(
    spark: SparkSession,
    root: str,
    sources: dict[str, tuple[DataFrame, str]],
    as_of: datetime,
    windows: Callable = packed_windows,
) -> tuple[DataFrame, DataFrame]:
    """``sources`` maps a name to (table, key column).  Returns the responses
    per document and the one-row report; the chunks are in
    ``{root}/chunks`` and the report in the processed zone."""
    raw, landed = {}, []
    for name, (rows, _) in sources.items():
        key = f"{name}/{as_of:%Y%m%d}"
        lake.store(rows, root, "raw", key, as_of, source=name, tags=[name], max_records=1_000_000)
        raw[name] = lake.load(spark, root, "raw", key, "parquet")
        landed.append(raw[name].agg(F.lit(name).alias("source"), F.count("*").alias("records")))
    profiles = profile_tables(raw)
    requests = []
    for name, (_, key_column) in sources.items():
        key = f"{name}/{as_of:%Y%m%d}"
        lake.promote(
            spark, root, "raw", "processed", key, "parquet", as_of,
            lambda df, k=key_column: process_table(df, as_of.isoformat(), keys=[k]),
        )
        lake.promote(
            spark, root, "processed", "curated", key, "parquet", as_of,
            lambda df, n=name, k=key_column: curate_rows(df, k, prefix=f"{n}_"),
        )
        requests.append(ingestion_requests(lake.load(spark, root, "curated", key, "parquet"), key))
    wanted = union_sources(requests)
    store = f"{root.rstrip('/')}/chunks"
    chunk_store.create(spark, store)
    change = chunk_store.begin(spark, store, f"etl-{as_of:%Y%m%d_%H%M%S}")
    chunk_store.insert(request_chunks(wanted, windows, as_of=as_of), store, change)
    answered = ingestion_responses(wanted, chunk_store.current(spark, store, with_changes=False))
    responses = written(answered, "responses")
    report = written(etl_report(profiles, union_sources(landed), responses), "report")
    lake.store(
        report, root, "processed", f"reports/{as_of:%Y%m%d_%H%M%S}", as_of, fmt="text", tags=["report"],
        metadata={"report_type": "execution"}, source="lake_etl",
    )
    return responses, report
