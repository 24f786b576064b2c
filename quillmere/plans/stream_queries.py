"""Queries over document events and streamed query logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmere.operators import chunk_store
from quillmere.operators.chunking import word_windows
from quillmere.plans import log_queries as lq, snippets as sn
from quillmere.plans.registry import query, stamp, table, texts
from quillmere.session import shared_dir
from quillmere.sources.jdbc import union_sources
from quillmere.streaming import events as ev, handlers, latest, metrics

# ---- events made from the documents ----
# all are created; German ones updated; toxic ones deleted; French ones get
# new metadata; English ones below 500 characters bring a broken message too


def _documents(spark, sf) -> DataFrame:
    minutes = F.col("doc_id").cast("int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return texts(spark, sf, "documents").select(
        "doc_id",
        F.col("doc_id").cast("string").alias("document_id"),
        "lang",
        "n_chars",
        F.col("text").alias("content"),
        F.create_map(F.lit("title"), F.col("source"), F.lit("tags"), F.lit('["a","b"]')).alias("metadata"),
        (start + F.make_dt_interval(mins=minutes)).alias("event_time"),
    )


def _later(df: DataFrame, days: int) -> DataFrame:
    return df.withColumn("event_time", F.col("event_time") + F.make_dt_interval(days=F.lit(days)))


def _deleted(spark, sf, documents: DataFrame) -> DataFrame:
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id")
    return documents.join(toxic, "doc_id", "left_semi")


def event_log(spark, sf) -> list[DataFrame]:
    """Messages in the order they are sent, offsets by document."""
    documents = _documents(spark, sf)
    german = _later(documents.filter("lang = 'de'"), 10).withColumns(
        {"content": F.concat(F.lit("updated "), F.col("content")), "update_type": F.lit("content")}
    )
    french = _later(documents.filter("lang = 'fr'"), 20).withColumn(
        "metadata", F.create_map(F.lit("title"), F.concat(F.lit("new "), F.col("document_id")))
    )
    broken = documents.filter("lang = 'en' and n_chars < 500").select(
        F.lit("rag-documents").alias("topic"), F.col("document_id").alias("key"), F.lit("{broken").alias("value")
    )
    sent = [
        ev.create_messages(documents), ev.update_messages(german), ev.metadata_messages(french),
        ev.delete_messages(_later(_deleted(spark, sf, documents), 30)), broken,
    ]
    place = F.pmod(F.xxhash64("key"), F.lit(3)).cast("int")
    return [
        m.select("*", place.alias("partition"), (F.col("key").cast("long") + F.lit(i * 1_000_000_000)).alias("offset"))
        for i, m in enumerate(sent)
    ]


_TOXIC = "(SELECT doc_id FROM labels WHERE toxic = 1)"
_SENT = f"""(
  SELECT 'rag-documents' AS topic, doc_id, 0 AS step, 'document_create' AS event_type FROM documents
  UNION ALL SELECT 'rag-document-updates', doc_id, 1, 'document_update' FROM documents WHERE lang = 'de'
  UNION ALL SELECT 'rag-metadata-updates', doc_id, 2, 'metadata_update' FROM documents WHERE lang = 'fr'
  UNION ALL SELECT 'rag-document-deletions', doc_id, 3, 'document_delete' FROM documents WHERE doc_id IN {_TOXIC})"""


@query("""SELECT doc_id::VARCHAR AS document_id, 'rag-documents' AS topic, doc_id::VARCHAR AS key, text AS content, source AS title,
  strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * doc_id, '%Y-%m-%d %H:%M:%S') AS event_time FROM documents""")
def event_round_trip(spark, sf):
    """Documents to JSON messages and back."""
    parsed = ev.parse(ev.create_messages(_documents(spark, sf)))
    return parsed.filter("reason is null").select(
        "document_id", "topic", "key", "content", F.col("metadata")["title"].alias("title"),
        stamp(F.col("event_time")).alias("event_time"),
    )


@query("""SELECT CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE lang || '_doc_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) END
  AS document_id, lang AS key, text AS content FROM documents""")
def batch_messages(spark, sf):
    """One batch per language; only English documents bring an id."""
    documents = _documents(spark, sf).withColumn("batch_id", F.col("lang"))
    unnamed = documents.withColumn("document_id", F.when(F.col("lang") == "en", F.col("document_id")))
    return ev.parse(ev.batch_messages(unnamed, "doc_id")).select("document_id", "key", "content")


@query(f"""SELECT doc_id::VARCHAR AS document_id, event_type FROM {_SENT} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1""")
def latest_event_per_document(spark, sf):
    parsed = ev.parse(union_sources(event_log(spark, sf))).filter("reason is null")
    return handlers.latest_events(parsed, ["event_type"])


@query(f"""SELECT doc_id::VARCHAR AS document_id, event_type FROM {_SENT} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY step DESC) = 1""")
def latest_event_stream(spark, sf):
    """The same from a stream of message files, kept up to date; every message
    is delivered twice."""
    root = shared_dir(spark, "latest")
    for part in event_log(spark, sf) * 2:
        part.write.mode("append").json(f"{root}/in")
    messages = ev.read_messages(spark, f"{root}/in", max_files=20)
    parsed = ev.parse(messages).filter("reason is null")
    latest.run(latest.latest_events(parsed, ["event_type"]), f"{root}/out", f"{root}/checkpoint")
    return latest.latest_of(spark.read.parquet(f"{root}/out")).select("document_id", "event_type")


_ALIVE = f"""(SELECT doc_id, CASE WHEN lang = 'de' THEN 'updated ' || text ELSE text END AS text,
  CASE WHEN lang = 'fr' THEN 'new ' || doc_id ELSE source END AS title FROM documents WHERE doc_id NOT IN {_TOXIC})"""


@query(f"SELECT id, content, title, 'a,b' AS tags FROM {sn.window_chunks(_ALIVE, 'doc_id', 'text', ', title')}")
def apply_event_stream(spark, sf):
    """Creates, updates, metadata changes and deletions streamed in two
    micro-batches into the chunk store."""
    root = shared_dir(spark, "stream")
    store, letters, checkpoint = f"{root}/store", f"{root}/dead", f"{root}/checkpoint"
    chunk_store.create(spark, store)
    create, update, change, delete, broken = event_log(spark, sf)
    for step in ([create, update], [change, delete, broken]):
        union_sources(step).write.mode("append").json(f"{root}/in")
        messages = ev.read_messages(spark, f"{root}/in")
        handlers.process(messages, store, letters, checkpoint, windows=word_windows).awaitTermination()
    meta = F.col("metadata")
    return chunk_store.current(spark, store).select(
        "id", "content", meta["title"].alias("title"), meta["tags"].alias("tags")
    )


@query(f"""SELECT count(*) AS chunks, count(DISTINCT doc_id) AS documents, CAST(sum(length(content)) AS BIGINT) AS characters
FROM (SELECT split_part(id, '_chunk_', 1) AS doc_id, content FROM {sn.window_chunks(_ALIVE, 'doc_id', 'text', ', title')})""")
def store_of_two_writers(spark, sf):
    """A batch load, compacted; then a stream with a checkpoint of its own
    updates and deletes; then the stream's messages once more under a lost
    checkpoint."""
    root = shared_dir(spark, "two-writers")
    loaded, store = f"{root}/loaded", f"{root}/store"
    create, update, change, delete, broken = event_log(spark, sf)
    chunk_store.create(spark, loaded)
    handlers.apply_events(ev.parse(create), loaded, chunk_store.begin(spark, loaded, "load"), windows=word_windows)
    chunk_store.compact(spark, loaded, store)
    union_sources([update, change, delete, broken]).write.json(f"{root}/in")
    for attempt in ("first", "again"):
        messages = ev.read_messages(spark, f"{root}/in")
        handlers.process(messages, store, f"{root}/dead", f"{root}/check-{attempt}", windows=word_windows).awaitTermination()
    rows = chunk_store.current(spark, store)
    return rows.agg(
        F.count("*").alias("chunks"), F.count_distinct("document_id").alias("documents"),
        F.sum(F.char_length("content")).alias("characters"),
    )


@query(f"""SELECT 'letters' AS what, count(*) * 3 AS n, count(*) AS last_attempts FROM documents WHERE lang = 'en' AND n_chars < 500
UNION ALL SELECT 'documents', count(DISTINCT split_part(id, '_chunk_', 1)), 0 FROM {sn.window_chunks('documents', 'doc_id', 'text')}""")
def retried_messages(spark, sf):
    """Broken messages come back until their third attempt; the others land."""
    root = shared_dir(spark, "retries")
    store, letters = f"{root}/store", f"{root}/dead"
    chunk_store.create(spark, store)
    create, *_, broken = event_log(spark, sf)
    union_sources([create, broken]).write.json(f"{root}/in")
    for _ in range(4):  # once more than there are attempts
        messages = ev.read_messages(spark, f"{root}/in")
        handlers.process(messages, store, letters, f"{root}/check", windows=word_windows).awaitTermination()
        handlers.retry(spark, letters, f"{root}/in", f"{root}/check-retry").awaitTermination()
    failed = handlers.dead_letter_table(spark, letters).agg(
        F.lit("letters").alias("what"), F.count("*").alias("n"), F.count_if(F.col("attempt") == 3).alias("last_attempts")
    )
    landed = chunk_store.current(spark, store).agg(
        F.lit("documents").alias("what"), F.count_distinct("document_id").alias("n"), F.lit(0).cast("long").alias("last_attempts")
    )
    return failed.unionByName(landed)


_SHORT = 80  # characters of a chunk that the model of this query refuses


@query(f"""SELECT split_part(id, '_chunk_', 1) AS document_id, CASE WHEN min(length(content)) < {_SHORT} THEN 0 ELSE count(*) END AS chunks,
  CASE WHEN min(length(content)) < {_SHORT} THEN 'cannot be encoded: ValueError: a text is too short' END AS reason
FROM {sn.window_chunks('documents', 'doc_id', 'text')} GROUP BY 1""")
def isolated_failures(spark, sf):
    """A stream into a store whose model raises at short texts: their documents
    are dead letters, the others land."""
    from quillmere.operators.embedding import isolating_encoder

    def load():
        import numpy as np

        def model(batch):
            if min(map(len, batch)) < _SHORT:
                raise ValueError("a text is too short")
            return np.array([[len(t), t.count("e"), 1.0] for t in batch])

        return model

    root = shared_dir(spark, "isolated")
    store, letters = f"{root}/store", f"{root}/dead"
    chunk_store.create(spark, store)
    ev.create_messages(_documents(spark, sf)).withColumns(
        {"partition": F.lit(0), "offset": F.col("key").cast("long")}).write.json(f"{root}/in")
    handlers.process(
        ev.read_messages(spark, f"{root}/in"), store, letters, f"{root}/check", windows=word_windows,
        encoder=isolating_encoder(load),
    ).awaitTermination()
    landed = chunk_store.current(spark, store).groupBy("document_id").agg(
        F.count_if(F.size("embedding") == 3).alias("chunks"), F.lit(None).cast("string").alias("reason"))
    failed = handlers.dead_letter_table(spark, letters).select(
        F.col("key").alias("document_id"), F.lit(0).cast("long").alias("chunks"), "reason")
    return landed.unionByName(failed)


@query("""SELECT 'rag-documents-dlq' AS topic, doc_id::VARCHAR AS key, 'not a JSON event' AS reason, 1::BIGINT AS attempt,
  'rag-documents' AS retry_topic FROM documents WHERE lang = 'en' AND n_chars < 500""")
def dead_letters(spark, sf):
    letters = ev.dead_letters(ev.parse(union_sources(event_log(spark, sf))))
    retried = ev.retryable(letters).withColumnRenamed("topic", "retry_topic")
    return retried.select(
        F.concat("retry_topic", F.lit("-dlq")).alias("topic"), "key", "reason", "attempt", "retry_topic"
    )


@query("""SELECT lang || '_' || doc_id AS document_id FROM documents
WHERE text <> '' AND octet_length(encode(text)) <= 4000 AND lang <> 'es'""")
def message_filter(spark, sf):
    """Size, required fields and excluded ids."""
    named = _documents(spark, sf).withColumn("document_id", F.concat_ws("_", "lang", "document_id"))
    parsed = ev.parse(ev.create_messages(named)).withColumn("value", F.col("content"))
    return ev.filter_events(parsed, max_bytes=4000, exclude=["es_*", "temp_*"]).select("document_id")


@query(f"""SELECT topic, max(doc_id + step::BIGINT * 1000000000)::BIGINT AS current_position, count(*) AS messages FROM (
  SELECT * FROM {_SENT} UNION ALL SELECT 'rag-documents', doc_id, 4, '' FROM documents WHERE lang = 'en' AND n_chars < 500) GROUP BY topic""")
def topic_progress(spark, sf):
    per = ev.progress(union_sources(event_log(spark, sf)))
    return per.groupBy("topic").agg(
        F.max("current_position").alias("current_position"), F.sum("messages").alias("messages")
    )


# ---- streamed query logs ----


def _log_stream(spark, sf) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return lq.logs(spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events*.parquet"))


@query(lq._hourly_sql())
def stream_hourly_analytics(spark, sf):
    root = shared_dir(spark, "hourly")
    query_ = metrics.run_complete(metrics.hourly_analytics(_log_stream(spark, sf)), f"{root}/out", f"{root}/checkpoint")
    return lq.hourly_columns(spark.read.parquet(f"{root}/out/batch={query_.lastProgress['batchId']}"))


@query(f"""WITH closed AS (SELECT max(created_at) - INTERVAL 10 MINUTE AS mark FROM {sn.LOGS})
SELECT {lq._RATE_OUT} FROM ({lq._rate_sql()}) WHERE window_end <= (SELECT mark FROM closed)""")
def stream_sliding_rate(spark, sf):
    """Append mode: the windows closed by the watermark."""
    root = shared_dir(spark, "rate")
    rates = metrics.sliding_rate(_log_stream(spark, sf), slide_seconds=60)
    metrics.run_to_end(rates, f"{root}/out", f"{root}/checkpoint")
    return lq.rate_columns(spark.read.parquet(f"{root}/out"))
