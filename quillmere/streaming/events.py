"""Document events: building, reading, parsing, filtering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from quillmere.functions.scalars import let, literal_map
from quillmere.schemas import DOCUMENT_TYPES, EVENT, MESSAGE, TOPICS

MAX_MESSAGE_BYTES = 10 * 1024 * 1024
MAX_ATTEMPTS = 3
ATTEMPT_HEADER = "attempt"

# Event types and the topic each belongs to.
EVENT_TOPICS = {
    "document_create": TOPICS["documents"],
    "document_update": TOPICS["updates"],
    "document_delete": TOPICS["deletions"],
    "metadata_update": TOPICS["metadata"],
}


def _message(df: DataFrame, event_type: str, key: Column, fields: dict[str, Column]) -> DataFrame:
    body = F.struct(
        F.lit(event_type).alias("event_type"),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.col("document_id"),
        *[c.alias(name) for name, c in fields.items()],
    )
    return df.select(
        F.lit(EVENT_TOPICS[event_type]).alias("topic"), key.alias("key"), F.to_json(body).alias("value")
    )


def create_messages(documents: DataFrame, partition_key: str | None = None) -> DataFrame:
    """Needs document_id, event_time, content, metadata."""
    data = F.struct("document_id", "content", "metadata")
    return _message(documents, "document_create", F.col(partition_key or "document_id"), {"data": data})


def update_messages(updates: DataFrame) -> DataFrame:
    """Needs document_id, event_time, update_type, content, metadata."""
    fields = {"update_type": F.col("update_type"), "data": F.struct("content", "metadata")}
    return _message(updates, "document_update", F.col("document_id"), fields)


def delete_messages(deletions: DataFrame) -> DataFrame:
    return _message(deletions, "document_delete", F.col("document_id"), {})


def metadata_messages(changes: DataFrame) -> DataFrame:
    return _message(changes, "metadata_update", F.col("document_id"), {"metadata": F.col("metadata")})


def numbered(df: DataFrame, by: str, order: str, block: int = 100_000) -> DataFrame:
    """Add ``position``, the 0-based place within ``by`` ordered by the unique
    whole number ``order``.

    Places are counted inside blocks of the order key and shifted by the size
    of the blocks before, so a group of any size is spread over many tasks.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy(by, "_block").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(by, "_block", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(by, "_block").orderBy(order))
    return (
        blocked.withColumn("_place", inside)
        .join(starts, [by, "_block"])
        .withColumn("position", F.col("_start") + F.col("_place") - 1)
        .drop("_block", "_start", "_place")
    )


def batch_messages(documents: DataFrame, order: str) -> DataFrame:
    """Create messages for batches (batch_id): documents without an id get
    {batch_id}_doc_{i}; the batch id is the key."""
    placed = numbered(documents, "batch_id", order)
    named = placed.withColumn(
        "document_id",
        F.coalesce(
            F.col("document_id"), F.concat_ws("_doc_", "batch_id", F.col("position").cast("string"))
        ),
    )
    return create_messages(named, partition_key="batch_id")


def read_messages(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Message stream from JSON files with topic, key, value, partition, offset;
    ``max_files`` limits a micro-batch."""
    attempted = T.StructType([*MESSAGE.fields, T.StructField("attempt", T.IntegerType())])  # null: never failed
    reader = spark.readStream.schema(attempted)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def read_kafka(spark: SparkSession, servers: str, per_trigger: int | None = None) -> DataFrame:
    """Message stream from a broker, where the Kafka package is installed;
    ``per_trigger`` limits the messages of a micro-batch."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(TOPICS.values()))
        .option("startingOffsets", "latest")
        .option("includeHeaders", "true")
    )
    if per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", per_trigger)
    return from_broker(reader.load())


def from_broker(rows: DataFrame) -> DataFrame:
    """Messages of a broker's rows; a header carries the attempts so far."""
    given = F.filter("headers", lambda h: h["key"] == ATTEMPT_HEADER)
    attempt = F.get(given, F.size(given) - 1)["value"].cast("string")  # the last one counts
    return rows.select(
        "topic", F.col("key").cast("string"), F.col("value").cast("string"), "partition", "offset",
        attempt.try_cast("int").alias("attempt"),
    )


def to_broker(messages: DataFrame) -> DataFrame:
    """Rows for a broker's writer (with includeHeaders): topic, key, value and
    the attempt, if there was one, as a header."""
    attempt = F.col("attempt").cast("int") if "attempt" in messages.columns else F.lit(None).cast("int")
    header = F.struct(F.lit(ATTEMPT_HEADER).alias("key"), attempt.cast("string").cast("binary").alias("value"))
    return messages.select("topic", "key", "value", F.when(attempt.isNotNull(), F.array(header)).alias("headers"))


def _event(e: Column, topic: Column) -> Column:
    """Columns of a parsed event, and why it cannot be handled (null if it can)."""
    event_type, time = e["event_type"], F.try_to_timestamp(e["timestamp"])
    metadata = F.coalesce(e["data"]["metadata"], e["metadata"])
    expected = literal_map(EVENT_TOPICS)
    reason = (
        F.when(event_type.isNull(), F.lit("not a JSON event"))
        .when(F.try_element_at(expected, event_type).isNull(), F.lit("unknown event type"))
        .when(F.try_element_at(expected, event_type) != topic, F.lit("wrong topic"))
        .when(e["document_id"].isNull(), F.lit("no document id"))
        .when(time.isNull(), F.lit("no event time"))
        .when(~F.try_element_at(metadata, F.lit("file_type")).isin(*DOCUMENT_TYPES), F.lit("unknown file type"))
    )
    return F.struct(
        event_type.alias("event_type"),
        time.alias("event_time"),
        e["document_id"].alias("document_id"),
        F.coalesce(e["update_type"], F.lit("content")).alias("update_type"),
        e["data"]["content"].alias("content"),
        metadata.alias("metadata"),
        reason.alias("reason"),
    )


def parse(messages: DataFrame) -> DataFrame:
    """The messages with their parsed event columns and ``reason``.

    The outer generator keeps filters on those columns above it, so each
    message is parsed once.
    """
    event = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    columns = let(event, lambda e: _event(e, F.col("topic")))
    return messages.select(*messages.columns, F.inline_outer(F.array(columns)))


def _glob(pattern: str) -> str:
    return "^" + pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".") + "$"


def filter_events(
    events: DataFrame, max_bytes: int = MAX_MESSAGE_BYTES, required: Sequence[str] = ("content", "metadata.title"),
    exclude: Sequence[str] = ("test_*", "temp_*"), content_types: Sequence[str] = (),
) -> DataFrame:
    """Keep wanted events: size, required fields, no excluded document ids,
    and the content types if any are given."""
    return events.filter(_wanted(max_bytes, required, exclude, content_types))


def passing(parsed: DataFrame, required: Sequence[str] = ("content",), **rules) -> DataFrame:
    """The filter of a stream of parsed messages: the rules hold for creations;
    other events pass unless the size or their document id rules them out, and
    what cannot be parsed passes, to become a dead letter."""
    kept = {k: v for k, v in rules.items() if k in ("max_bytes", "exclude")}
    for_all = _wanted(**{"max_bytes": MAX_MESSAGE_BYTES, "exclude": ("test_*", "temp_*"), **kept}, required=(), content_types=())
    for_creations = _wanted(required=required, exclude=(), max_bytes=MAX_MESSAGE_BYTES, content_types=rules.get("content_types", ()))
    return parsed.filter(
        F.col("reason").isNotNull() | (for_all & ((F.col("event_type") != "document_create") | for_creations)))


def _wanted(max_bytes: int, required: Sequence[str], exclude: Sequence[str], content_types: Sequence[str]) -> Column:
    wanted = F.octet_length("value") <= max_bytes
    for name in required:
        field = (
            F.try_element_at("metadata", F.lit(name.split(".", 1)[1])) if name.startswith("metadata.") else F.col(name)
        )
        wanted = wanted & F.coalesce(field != "", F.lit(False))
    for pattern in exclude:
        wanted = wanted & ~F.coalesce(F.col("document_id").rlike(_glob(pattern)), F.lit(False))
    if content_types:
        given = F.try_element_at("metadata", F.lit("content_type"))
        wanted = wanted & (given.isNull() | given.isin(*content_types))
    return wanted


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Failed messages for the dead-letter topic, with reason and attempt."""
    attempt = F.coalesce("attempt", F.lit(0)) if "attempt" in parsed.columns else F.lit(0)
    return parsed.filter(F.col("reason").isNotNull()).select(
        F.concat("topic", F.lit("-dlq")).alias("topic"), "key", "value", "reason",
        (attempt + 1).cast("int").alias("attempt"),
    )


def retryable(letters: DataFrame, limit: int = MAX_ATTEMPTS) -> DataFrame:
    """Dead letters with attempts left, under their own topic again."""
    return letters.filter(F.col("attempt") < limit).withColumn(
        "topic", F.regexp_replace("topic", "-dlq$", "")
    )


def progress(messages: DataFrame) -> DataFrame:
    """Position and message count per topic and partition."""
    return messages.groupBy("topic", "partition").agg(
        F.max("offset").alias("current_position"), F.count("*").alias("messages")
    )


def request_of(events: DataFrame, default_tags: Column) -> DataFrame:
    """Ingestion request columns with the defaults of streamed documents."""
    meta = lambda name: F.try_element_at("metadata", F.lit(name))
    return events.select(
        "document_id",
        F.col("content").alias("file_content"),
        F.lit(None).cast("string").alias("file_url"),
        F.coalesce(meta("filename"), F.concat("document_id", F.lit(".txt"))).alias("filename"),
        F.char_length("content").alias("file_size"),
        F.coalesce(meta("file_type"), F.lit("txt")).alias("file_type"),
        F.coalesce(meta("title"), F.col("document_id")).alias("title"),
        meta("source_url").alias("source_url"),
        F.coalesce(F.from_json(meta("tags"), "array<string>"), default_tags).alias("tags"),
        F.lit(True).alias("process_immediately"),
    )
