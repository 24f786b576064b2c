"""Explicit schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType(),
)
STRING_MAP = T.MapType(_S, _S)
VECTOR = T.ArrayType(T.FloatType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# Allowed states, document types, lake zones, event topics.
DOCUMENT_STATUSES = ("pending", "processing", "completed", "failed")
DOCUMENT_TYPES = ("pdf", "docx", "txt", "md", "html", "csv", "xlsx")
ZONES = ("raw", "processed", "curated", "documents", "models")
TOPICS = {
    "documents": "rag-documents",
    "updates": "rag-document-updates",
    "deletions": "rag-document-deletions",
    "metadata": "rag-metadata-updates",
}

DOCUMENT_METADATA = _schema(
    ("filename", _S), ("file_size", _L), ("file_type", _S), ("upload_date", _TS), ("source_url", _S),
    ("author", _S), ("title", _S), ("tags", T.ArrayType(_S)), ("custom_metadata", STRING_MAP),
)
DOCUMENTS = _schema(
    ("id", _S), ("filename", _S), ("file_type", _S), ("file_size", _L), ("title", _S), ("author", _S),
    ("source_url", _S), ("tags", T.ArrayType(_S)), ("status", _S), ("created_at", _TS),
    ("updated_at", _TS), ("processed_at", _TS), ("chunk_count", _I), ("metadata", STRING_MAP),
)
CHUNKS = _schema(
    ("id", _S), ("document_id", _S), ("chunk_index", _I), ("content", _S), ("embedding", VECTOR),
    ("metadata", STRING_MAP),
)
QUERY_LOGS = _schema(
    ("id", _S), ("user_id", _S), ("query_text", _S), ("response_time_ms", _I), ("num_results", _I),
    ("confidence_score", _D), ("cached", _B), ("created_at", _TS), ("ip_address", _S), ("user_agent", _S),
)
SYSTEM_METRICS = _schema(
    ("id", _S), ("metric_name", _S), ("metric_value", _D), ("metric_unit", _S), ("metadata", STRING_MAP),
    ("created_at", _TS),
)
ASSETS = _schema(
    ("path", _S), ("zone", _S), ("key", _S), ("format", _S), ("size_bytes", _L), ("created_at", _TS),
    ("metadata", STRING_MAP), ("tags", T.ArrayType(_S)), ("source", _S), ("version", _S),
)
EVENT_DATA = _schema(("document_id", _S), ("content", _S), ("metadata", STRING_MAP))
EVENT = _schema(
    ("event_type", _S), ("timestamp", _S), ("document_id", _S), ("update_type", _S),
    ("data", EVENT_DATA), ("metadata", STRING_MAP),
)
MESSAGE = _schema(("topic", _S), ("key", _S), ("value", _S), ("partition", _I), ("offset", _L))
