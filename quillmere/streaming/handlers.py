"""Applying document events to the chunk store, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmere.functions.joins import skew_join
from quillmere.operators import chunk_store
from quillmere.operators.chunking import packed_windows
from quillmere.operators.ingestion import request_chunks
from quillmere.session import written
from quillmere.streaming import events as ev

# Default tags of streamed documents.
CREATE_TAGS = ("streaming", "kafka")
UPDATE_TAGS = ("streaming", "kafka", "updated")


def in_order():
    """Order of the events of one document."""
    return F.struct("event_time", event_rank(), "offset")


def event_rank():
    """Order of events of one document at the same moment: offsets of different
    topics do not compare, so a creation comes first and a deletion last."""
    kinds = ("document_create", "document_update", "metadata_update", "document_delete")
    return F.coalesce(F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("event_type")), F.lit(0))


EVENT_COLUMNS = ("event_type", "update_type", "content", "metadata", "event_time", "offset")


def latest_events(parsed: DataFrame, columns: Sequence[str] = EVENT_COLUMNS) -> DataFrame:
    """Last event per document, on a batch or (update mode) on a stream.  The
    maximum is kept per task, so a busy document is one row per task; on a
    stream name only the columns that are needed, they make up the state."""
    last = F.max_by(F.struct(*columns), in_order())
    return parsed.groupBy("document_id").agg(last.alias("_e")).select("document_id", "_e.*")


def content_events(parsed: DataFrame) -> DataFrame:
    """Events that decide a document's content: deletions, and creations or
    content updates that carry any."""
    with_content = F.coalesce(F.col("content"), F.lit("")) != ""
    return parsed.filter(
        (F.col("event_type") == "document_delete")
        | ((F.col("event_type") == "document_create") & with_content)
        | ((F.col("event_type") == "document_update") & (F.col("update_type") == "content") & with_content)
    )


def metadata_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(
        (F.col("event_type") == "metadata_update")
        | ((F.col("event_type") == "document_update") & (F.col("update_type") == "metadata"))
    ).filter(F.col("metadata").isNotNull())


def apply_events(
    parsed: DataFrame, store: str, change: chunk_store.Change, windows=packed_windows, encoder=None
) -> DataFrame:
    """Apply one batch of parsed messages to the store as ``change`` and return
    the dead letters.  Repeating a change writes the same folders again.

    With an isolating encoder a document one of whose chunks cannot be encoded
    is left as the store has it, and its message is a dead letter."""
    good = parsed.filter(F.col("reason").isNull())
    last = latest_events(content_events(good)).persist()
    try:
        failed = _apply(good, last, store, change, windows, encoder)
    finally:
        last.unpersist()
    if failed is None:
        return ev.dead_letters(parsed)
    return ev.dead_letters(parsed).unionByName(ev.dead_letters(_failed_messages(good, failed, parsed.columns)))


def _failed_messages(good: DataFrame, failed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The messages that the failed documents' content came from."""
    joined = skew_join(content_events(good), failed, ["document_id"], "inner", spread=["offset"])
    return joined.filter(in_order() == F.col("_order")).withColumn("reason", F.col("_error")).select(*columns)


def _apply(
    good: DataFrame, last: DataFrame, store: str, change: chunk_store.Change, windows, encoder
) -> DataFrame | None:
    alive = last.filter(F.col("event_type") != "document_delete")
    tags = F.when(F.col("event_type") == "document_update", F.array(*[F.lit(t) for t in UPDATE_TAGS])).otherwise(
        F.array(*[F.lit(t) for t in CREATE_TAGS])
    )
    chunks, applied, failed = request_chunks(ev.request_of(alive, tags), windows, encoder), last, None
    if "encode_error" in chunks.columns:
        # encoded once, here; what is written depends on what failed
        chunks = written(chunks, "encoded")
        errors = chunks.groupBy("document_id").agg(F.min("encode_error").alias("_error")).filter("_error is not null")
        order = last.select("document_id", in_order().alias("_order"))
        failed = written(errors.join(order, "document_id").withColumn("_error", F.concat(F.lit("cannot be encoded: "), "_error")), "failed")
        chunks = skew_join(chunks, failed.select("document_id"), ["document_id"], "left_anti", spread=["id"])
        applied = last.join(failed, "document_id", "left_anti")
    chunk_store.replace(chunks, applied, store, change)
    since = applied.select("document_id", in_order().alias("_since"))
    changes = skew_join(metadata_events(good), since, ["document_id"], "left", spread=["offset"]).filter(
        F.col("_since").isNull() | (in_order() > F.col("_since"))
    )
    sequence = F.concat_ws(
        "-", F.lpad(F.unix_micros("event_time").cast("string"), 20, "0"),
        F.lpad(F.coalesce("offset", F.lit(0)).cast("string"), 20, "0"),
    )
    chunk_store.change_metadata(changes.withColumn("sequence", sequence), store, change)
    return failed


def process(
    messages: DataFrame, store: str, dead_letter_path: str, checkpoint: str, every: str | None = None,
    windows=packed_windows, encoder=None, wanted: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Run the handlers over a message stream.  ``every`` is the micro-batch
    interval, e.g. '30 seconds'; without it what is there is processed and the
    query ends.  ``wanted`` takes the parsed messages and leaves those to be
    handled, e.g. ``events.passing``; the others are neither applied nor dead
    letters."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the query's id belongs to its checkpoint: a new checkpoint is a new writer
        writer = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        change = chunk_store.begin(spark, store, f"stream-{writer}", batch_id)
        parsed = (wanted or (lambda rows: rows))(ev.parse(batch))
        if encoder is None:  # only a message that failed is needed again: the others are kept once, not twice
            parsed = parsed.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value")))
        parsed = parsed.persist()
        try:
            letters = apply_events(parsed, store, change, windows, encoder)
            letters.write.mode("overwrite").parquet(change.folder(dead_letter_path, "letters"))
        finally:
            parsed.unpersist()

    writer = messages.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def query_progress(query: StreamingQuery) -> list[dict]:
    """Per source: read positions and row count of the last micro-batch."""
    last = query.lastProgress
    if not last:
        return []
    return [
        {"source": s["description"], "start": s["startOffset"], "end": s["endOffset"], "rows": s["numInputRows"]}
        for s in last["sources"]
    ]


def publish(messages: DataFrame, path: str, checkpoint: str | None = None):
    """Write messages: a batch at once, a stream until its input ends."""
    if not messages.isStreaming:
        messages.write.mode("append").json(path)
        return None
    return (
        messages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def retry(spark: SparkSession, dead_letter_path: str, messages_path: str, checkpoint: str) -> StreamingQuery:
    """Send new dead letters with attempts left back to the message folder,
    each once, with their attempt count; those without stay where they are."""
    schema = "topic string, key string, value string, reason string, attempt int"
    letters = spark.readStream.schema(schema).parquet(f"{dead_letter_path}/letters/*/*")
    again = ev.retryable(letters).select("topic", "key", "value", "attempt")
    return publish(again, messages_path, checkpoint)


def dead_letter_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "topic string, key string, value string, reason string, attempt int, version long, writer string"
    ).parquet(f"{path}/letters")
