"""Processed rows to documents, and documents to ingestion requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MIN_TEXT = 50


def curate_rows(df: DataFrame, key: str, prefix: str = "doc_") -> DataFrame:
    """Text fields over 50 characters become "column: value" lines, all other
    fields metadata; rows without such text are dropped.  The id comes from
    the row's key, so it needs no global row number."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    is_long = {c: F.coalesce(F.char_length(f"`{c}`") > MIN_TEXT, F.lit(False)) for c in texts}
    lines = [F.when(is_long[c], F.concat(F.lit(f"{c}: "), F.col(f"`{c}`"))) for c in texts]
    pairs = [
        F.struct(
            F.lit(c).alias("key"),
            F.col(f"`{c}`").cast("string").alias("value"),
            (~is_long[c] if c in is_long else F.lit(True)).alias("keep"),
        )
        for c in df.columns
    ]
    kept = F.filter(F.array(*pairs), lambda p: p["keep"])
    metadata = F.map_from_entries(F.transform(kept, lambda p: F.struct(p["key"], p["value"])))
    return df.select(
        F.concat_ws("\n", *lines).alias("content"),
        metadata.alias("metadata"),
        F.concat(F.lit(prefix), F.col(key).cast("string")).alias("document_id"),
    ).filter(F.col("content") != "")


def ingestion_requests(curated: DataFrame, asset_key: str) -> DataFrame:
    """One request per curated document."""
    return curated.filter(F.coalesce(F.col("content"), F.lit("")) != "").select(
        "document_id",
        F.col("content").alias("file_content"),
        F.lit(None).cast("string").alias("file_url"),
        F.concat("document_id", F.lit(".txt")).alias("filename"),
        F.char_length("content").alias("file_size"),
        F.lit("txt").alias("file_type"),
        F.col("document_id").alias("title"),
        F.lit(f"data_lake://curated/{asset_key}").alias("source_url"),
        F.array(F.lit("data_lake"), F.lit("curated")).alias("tags"),
        F.lit(True).alias("process_immediately"),
    )


# Response texts.
NO_INPUT = "Either file_url or file_content must be provided"
TWO_INPUTS = "Only one of file_url or file_content should be provided"
NO_URLS = "URL loading not yet implemented"


def check_requests(requests: DataFrame) -> DataFrame:
    """Add error: exactly one of url and content, and urls cannot be loaded."""
    has_url = F.coalesce(F.col("file_url") != "", F.lit(False))
    has_content = F.coalesce(F.col("file_content") != "", F.lit(False))
    return requests.withColumn(
        "error",
        F.when(~has_url & ~has_content, F.lit(NO_INPUT))
        .when(has_url & has_content, F.lit(TWO_INPUTS))
        .when(has_url, F.lit(NO_URLS)),
    )
