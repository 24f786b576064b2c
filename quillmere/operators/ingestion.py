"""Ingestion requests to stored, embedded chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillmere.functions.joins import skew_join
from quillmere.operators.chunking import chunk_documents, packed_windows, with_chunk_metadata
from quillmere.operators.curation import check_requests
from quillmere.operators.embedding import embed
from quillmere.sources.files import to_text


# Response texts.
FAILED = "Failed to ingest document: "
PROCESSED = "Successfully processed document with "


def request_chunks(
    requests: DataFrame,
    windows: Callable[[Column], Column] = packed_windows,
    encoder: Callable[[Column], Column] | None = None,
    as_of=None,
) -> DataFrame:
    """Chunks with metadata and vectors for all acceptable requests.  One pass
    without a shuffle: load by type, clean, cut, embed."""
    good = check_requests(requests).filter(F.col("error").isNull())
    text = {"filename": "filename", "file_type": "file_type", "title": "title", "source_url": "source_url"}
    pairs = [item for key, column in text.items() for item in (F.lit(key), F.col(column))]
    metadata = F.create_map(
        *pairs,
        F.lit("file_size"), F.col("file_size").cast("string"),
        F.lit("tags"), F.array_join("tags", ","),
        F.lit("upload_date"), F.lit(None if as_of is None else str(as_of)),
    )
    documents = good.select(
        "document_id",
        to_text(F.col("file_type"), F.col("filename"), F.col("file_content")).alias("content"),
        metadata.alias("metadata"),
    )
    chunks = chunk_documents(documents, windows=windows, metadata_col="metadata")
    return embed(with_chunk_metadata(chunks), encoder=encoder).drop("total_chunks")


def ingestion_responses(requests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: status, message, chunks created.

    The chunks are counted before the join, so a document with very many
    chunks is one row there."""
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks_created"))
    checked = check_requests(requests).select("document_id", "process_immediately", "error")
    created = F.coalesce(F.col("chunks_created"), F.lit(0))
    return checked.join(counts, "document_id", "left").select(
        "document_id",
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.col("process_immediately"), F.lit("completed"))
        .otherwise(F.lit("pending"))
        .alias("status"),
        F.when(F.col("error").isNotNull(), F.concat(F.lit(FAILED), F.col("error")))
        .otherwise(
            F.concat(F.lit(PROCESSED), created.cast("string"), F.lit(" chunks"))
        )
        .alias("message"),
        F.when(F.col("error").isNull(), created).otherwise(F.lit(0)).alias("chunks_created"),
    )


def ingestion_summary(responses: DataFrame) -> DataFrame:
    return responses.agg(
        F.count_if(F.col("status") == "completed").alias("successful"),
        F.count_if(F.col("status") != "completed").alias("failed"),
        F.coalesce(F.sum("chunks_created"), F.lit(0)).alias("total_chunks"),
    )


def document_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """All documents with their actual chunk count."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("id").alias("actual_chunk_count"))
    return documents.join(counts, "id", "left").withColumn(
        "actual_chunk_count", F.coalesce("actual_chunk_count", F.lit(0))
    )


def cascade_delete(chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """Chunks whose document was not deleted."""
    gone = deleted.select(F.col("id").alias("document_id")).distinct()
    return skew_join(chunks, gone, ["document_id"], "left_anti", spread=["id"])


def forget_users(logs: DataFrame, deleted_users: DataFrame) -> DataFrame:
    """Logs of deleted users keep their row and lose the user id."""
    gone = deleted_users.select("user_id", F.lit(True).alias("_gone")).distinct()
    joined = skew_join(logs, gone, ["user_id"], "left", spread=["id"])
    return joined.withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).select(logs.columns)


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Add the rows whose key is new; of several new rows with one key the
    first by value counts."""
    fresh = rows.groupBy(key).agg(F.min(F.struct(*[c for c in table.columns if c != key])).alias("_row"))
    fresh = fresh.select(key, "_row.*").select(table.columns)
    known = table.select(key).distinct()
    return table.unionByName(fresh.join(known, key, "left_anti"))
