import json

import pytest

from quillmere.operators import chunk_store
from quillmere.operators.chunking import word_windows
from quillmere.plans.catalog import QUERIES
from quillmere.schemas import MESSAGE, TOPICS
from quillmere.session import Folder, shared_dir
from quillmere.streaming import events as ev, handlers, latest


def message(topic, offset, minute, event_type, document_id, **body):
    value = {"event_type": event_type, "timestamp": f"2024-01-01T00:{minute:02d}:00.000000", "document_id": document_id, **body}
    return (TOPICS[topic], document_id, json.dumps(value), 0, offset)


def seen(spark, store):
    return {r["document_id"]: (r["content"], r["metadata"]) for r in chunk_store.current(spark, store).collect()}


@pytest.fixture
def first(spark):
    rows = [
        message("documents", 1, 1, "document_create", "a", data={"content": "one", "metadata": {"title": "T", "tags": ["x"]}}),
        message("documents", 2, 1, "document_create", "b", data={"content": "two"}),
        message("documents", 3, 1, "document_create", "empty", data={"content": ""}),
        message("documents", 4, 1, "document_create", "c", data={"content": "gone soon"}),
        message("deletions", 5, 2, "document_delete", "c"),
        message("deletions", 6, 2, "document_delete", "unknown"),
        message("updates", 7, 3, "document_update", "b", update_type="content", data={"content": "two again"}),
        message("updates", 8, 0, "document_update", "b", update_type="content", data={"content": "too old"}),
        message("metadata", 9, 4, "metadata_update", "a", metadata={"title": "T2"}),
        message("metadata", 10, 0, "metadata_update", "a", metadata={"title": "before the create"}),
        message("metadata", 11, 4, "metadata_update", "nobody", metadata={"title": "?"}),
        (TOPICS["documents"], "x", "{broken", 0, 12),
        message("documents", 13, 1, "document_delete", "a"),
        message("documents", 14, 1, "document_create", "p", data={"content": "x", "metadata": {"file_type": "exe"}}),
    ]
    return spark.createDataFrame(rows, MESSAGE)


def test_one_batch(spark, first):
    store = shared_dir(spark, "s")
    chunk_store.create(spark, store)
    letters = handlers.apply_events(ev.parse(first), store, chunk_store.begin(spark, store, "t", 1), windows=word_windows)
    got = seen(spark, store)
    assert {d: c for d, (c, _) in got.items()} == {"a": "one", "b": "two again"}
    assert got["a"][1]["title"] == "T2" and got["a"][1]["tags"] == "x" and got["a"][1]["filename"] == "a.txt"
    assert got["b"][1]["tags"] == "streaming,kafka,updated" and got["b"][1]["title"] == "b"
    assert {(r["key"], r["reason"]) for r in letters.collect()} == {
        ("x", "not a JSON event"), ("a", "wrong topic"), ("p", "unknown file type")
    }
    handlers.apply_events(ev.parse(first), store, chunk_store.begin(spark, store, "t", 1), windows=word_windows)  # a repeated micro-batch
    assert seen(spark, store) == got


def test_batches_equal_the_whole(spark, first):
    whole, parts = shared_dir(spark, "s"), shared_dir(spark, "s")
    chunk_store.create(spark, whole)
    chunk_store.create(spark, parts)
    ordered = first.filter("offset not in (8, 10)")
    handlers.apply_events(ev.parse(ordered), whole, chunk_store.begin(spark, whole, "t", 1), windows=word_windows)
    for version, where in enumerate(("offset <= 4 or offset > 11", "offset between 5 and 7", "offset between 9 and 11"), 1):
        handlers.apply_events(ev.parse(ordered.filter(where)), parts, chunk_store.begin(spark, parts, "t", version), windows=word_windows)
    assert seen(spark, parts) == seen(spark, whole)


def test_retries_end(spark):
    letters = spark.createDataFrame([("t-dlq", "k", "v", "r", n) for n in (1, 2, 3)], "topic string, key string, value string, reason string, attempt int")
    again = ev.retryable(letters).collect()
    assert [(r["topic"], r["attempt"]) for r in again] == [("t", 1), ("t", 2)]
    third = ev.dead_letters(ev.retryable(letters).withColumn("reason", ev.F.lit("r")))
    assert sorted(r["attempt"] for r in third.collect()) == [2, 3]


def test_stream_restart_continues(spark, first):
    root = shared_dir(spark, "s")
    store = f"{root}/store"
    chunk_store.create(spark, store)
    for where in ("offset <= 4", "offset > 4 and offset not in (8, 10)"):
        first.filter(where).coalesce(1).write.mode("append").json(f"{root}/in")
        query = handlers.process(ev.read_messages(spark, f"{root}/in"), store, f"{root}/dead", f"{root}/check", windows=word_windows)
        query.awaitTermination()
    assert {d: c for d, (c, _) in seen(spark, store).items()} == {"a": "one", "b": "two again"}
    assert handlers.dead_letter_table(spark, f"{root}/dead").count() == 3
    assert handlers.query_progress(query)[0]["rows"] > 0
    writers = Folder(spark, f"{store}/owners").names()
    assert len(writers) == 2 and not any("None" in w for w in writers)
    # a lost checkpoint: everything comes again, as another writer, and nothing is lost
    target = f"{root}/compacted"
    chunk_store.compact(spark, store, target)
    first.filter("offset = 4").coalesce(1).write.json(f"{root}/more")
    again = handlers.process(ev.read_messages(spark, f"{root}/more"), target, f"{root}/dead2", f"{root}/check2", windows=word_windows)
    again.awaitTermination()
    assert set(seen(spark, store)) <= set(seen(spark, target))
    handlers.process(ev.read_messages(spark, f"{root}/in"), store, f"{root}/dead", f"{root}/check3", windows=word_windows).awaitTermination()
    assert {d: c for d, (c, _) in seen(spark, store).items()} == {"a": "one", "b": "two again"}


def test_publish_batch(spark):
    root = shared_dir(spark, "s")
    documents = spark.createDataFrame([("a", "2024-01-01 00:00:00", "c", {"title": "t"})], "document_id string, event_time string, content string, metadata map<string,string>")
    documents = documents.withColumn("event_time", ev.F.col("event_time").cast("timestamp"))
    handlers.publish(ev.create_messages(documents), root)
    row = ev.parse(spark.read.schema(MESSAGE).json(root)).first()
    assert (row["document_id"], row["content"], row["reason"]) == ("a", "c", None)


def _refusing(word):
    def load():
        import numpy as np

        def model(texts):
            if any(word in t for t in texts):
                raise RuntimeError(f"refuses {word}")
            return np.array([[len(t), 1.0] for t in texts])

        return model

    return load


def test_a_failing_batch_is_halved(spark):
    from quillmere.operators.embedding import embed, isolating_encoder

    texts = [f"text {i}" + (" bad" if i in (3, 4, 90) else "") for i in range(100)] + [None]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, content string").coalesce(1)
    got = {r["id"]: r for r in embed(rows, encoder=isolating_encoder(_refusing("bad"), batch_size=16)).collect()}
    assert {i for i, r in got.items() if r["encode_error"]} == {3, 4, 90}
    assert {r["encode_error"] for r in got.values()} == {None, "RuntimeError: refuses bad"}
    assert {i for i, r in got.items() if r["embedding"] is None} == {3, 4, 90, 100}
    assert embed(rows.limit(0), encoder=isolating_encoder(_refusing("bad"))).count() == 0
    kept = rows.withColumn("embedding", ev.F.when(ev.F.col("id") == 3, ev.F.array(ev.F.lit(1.0).cast("float"))))
    again = embed(kept, encoder=isolating_encoder(_refusing("bad"))).filter("id = 3").first()
    assert (again["embedding"], again["encode_error"]) == ([1.0], None)  # a text with a vector is not sent


def test_failures_are_set_aside(spark):
    from quillmere.operators.embedding import isolating_encoder

    store, encoder = shared_dir(spark, "s"), isolating_encoder(_refusing("poison"))
    chunk_store.create(spark, store)
    batch = lambda *rows: ev.parse(spark.createDataFrame(list(rows), MESSAGE))
    step = lambda n: chunk_store.begin(spark, store, "t", n)
    first = batch(
        message("documents", 1, 1, "document_create", "a", data={"content": "one"}),
        message("documents", 2, 1, "document_create", "b", data={"content": "poison"}),
        message("documents", 3, 1, "document_create", "c", data={"content": "poison first"}),
        message("updates", 4, 2, "document_update", "c", update_type="content", data={"content": "mended"}),
        (TOPICS["documents"], "x", "{broken", 0, 5),
    )
    letters = handlers.apply_events(first, store, step(1), windows=word_windows, encoder=encoder).collect()
    assert {(r["topic"], r["key"], r["attempt"]) for r in letters} == {("rag-documents-dlq", "b", 1), ("rag-documents-dlq", "x", 1)}
    assert {r["reason"] for r in letters} == {"not a JSON event", "cannot be encoded: RuntimeError: refuses poison"}
    assert {d: c for d, (c, _) in seen(spark, store).items()} == {"a": "one", "c": "mended"}
    second = batch(
        message("updates", 6, 3, "document_update", "a", update_type="content", data={"content": "poisoned"}),
        message("deletions", 7, 3, "document_delete", "c"),
    )
    letters = handlers.apply_events(second, store, step(2), windows=word_windows, encoder=encoder).collect()
    assert [(r["topic"], r["key"]) for r in letters] == [("rag-document-updates-dlq", "a")]
    assert {d: c for d, (c, _) in seen(spark, store).items()} == {"a": "one"}  # what was there stays


def test_attempts_travel_in_a_header(spark):
    letters = spark.createDataFrame([("t", "k", "v", 2), ("t", "k2", None, None)], "topic string, key string, value string, attempt int")
    sent = ev.to_broker(letters)
    rows = sent.select("*", ev.F.lit(0).alias("partition"), ev.F.lit(7).cast("long").alias("offset"))
    got = sorted(tuple(r) for r in ev.from_broker(rows).collect())
    assert got == [("t", "k", "v", 0, 7, 2), ("t", "k2", None, 0, 7, None)]
    odd = rows.limit(1).withColumn("headers", ev.F.expr("array(struct('attempt' AS key, CAST('1' AS BINARY) AS value), struct('attempt' AS key, CAST('x' AS BINARY) AS value))"))
    assert ev.from_broker(odd).first()["attempt"] is None
    failed = ev.parse(ev.from_broker(rows)).filter("key = 'k'")
    assert ev.dead_letters(failed).first()["attempt"] == 3


def test_unwanted_messages_are_passed_over(spark):
    rows = [
        message("documents", 1, 1, "document_create", "a", data={"content": "one", "metadata": {"content_type": "text"}}),
        message("documents", 2, 1, "document_create", "test_b", data={"content": "two"}),
        message("documents", 3, 1, "document_create", "c", data={"content": "", "metadata": {"content_type": "text"}}),
        message("documents", 4, 1, "document_create", "d", data={"content": "x", "metadata": {"content_type": "video"}}),
        message("deletions", 5, 2, "document_delete", "e"),
        message("deletions", 6, 2, "document_delete", "test_e"),
        (TOPICS["documents"], "x", "{broken", 0, 7),
    ]
    kept = ev.passing(ev.parse(spark.createDataFrame(rows, MESSAGE)), content_types=["text"])
    assert sorted(r["offset"] for r in kept.collect()) == [1, 5, 7]


def test_latest_events_end_and_ignore_repeats(spark, first):
    """Messages delivered again, late and out of order give no row; the state
    of silent documents goes after its time."""
    import time

    from quillmere.streaming import latest

    root, shape = shared_dir(spark, "s"), spark.createDataFrame([], MESSAGE).schema
    sent = lambda name, rows: rows.coalesce(1).write.mode("append").json(f"{root}/in/{name}")

    def step(ttl):
        messages = spark.readStream.schema(shape).option("recursiveFileLookup", "true").json(f"{root}/in")
        found = latest.latest_events(ev.parse(messages).filter("reason is null"), ["event_type"], ttl)
        query = latest.run(found, f"{root}/out", f"{root}/check")
        changed = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
        return query.lastProgress["stateOperators"][0]["numRowsTotal"], sum(changed)

    sent("a", first.filter("offset <= 8"))
    rows, changed = step(3600)
    assert rows > 0 and changed > 0
    count = spark.read.parquet(f"{root}/out").count()
    sent("b", first.filter("offset <= 8"))
    step(3600)
    assert spark.read.parquet(f"{root}/out").count() == count  # nothing new
    sent("c", first)
    step(3600)
    got = {r["document_id"]: r["event_type"] for r in latest.latest_of(spark.read.parquet(f"{root}/out")).collect()}
    wanted = handlers.latest_events(ev.parse(first).filter("reason is null"), ["event_type"]).collect()
    assert got == {r["document_id"]: r["event_type"] for r in wanted}

    root = shared_dir(spark, "s")
    sent("a", first.filter("offset <= 4"))
    assert step(1)[0] >= 4
    time.sleep(2)
    sent("b", first.filter("offset = 5"))
    assert step(1)[0] <= 3  # the others' time is over


@pytest.mark.parametrize("name", ["store_of_two_writers", "retried_messages", "apply_event_stream"])
def test_message_files_are_written_by_the_input_s_tasks(spark, tmp_path, monkeypatch, name):
    """No query gathers its messages in a fixed number of tasks: here four, each with a share of the whole input."""
    from pyspark.sql import DataFrameWriter

    class Written(Exception):
        pass

    def look(self, path, *args, **kwargs):
        raise Written(self._df.rdd.getNumPartitions())

    base = str(tmp_path)
    spark.range(400).selectExpr(
        "id AS doc_id", "concat('word ', id) AS text", "element_at(array('en', 'de', 'fr'), int(id % 3) + 1) AS lang",
        "'web' AS source", "8 AS n_chars").write.parquet(f"{base}/documents.parquet")
    spark.range(0, 400, 5).selectExpr("id AS doc_id", "1 AS toxic").write.parquet(f"{base}/labels.parquet")
    monkeypatch.setattr(DataFrameWriter, "json", look)
    with pytest.raises(Written) as tasks:
        QUERIES[name](spark, base)
    assert tasks.value.args[0] >= 2 * spark.sparkContext.defaultParallelism


def test_good_messages_are_kept_once(spark, first, tmp_path, monkeypatch):
    kept, apply = [], handlers.apply_events

    def look(parsed, *args, **kwargs):
        kept.extend((r["value"] is None, r["reason"] is None) for r in parsed.collect())
        return apply(parsed, *args, **kwargs)

    monkeypatch.setattr(handlers, "apply_events", look)
    first.coalesce(1).write.json(f"{tmp_path}/in")
    chunk_store.create(spark, f"{tmp_path}/store")
    handlers.process(
        ev.read_messages(spark, f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/dead", f"{tmp_path}/check", windows=word_windows,
    ).awaitTermination()
    assert len(kept) == 14 and all(bare == good for bare, good in kept)
    letters = handlers.dead_letter_table(spark, f"{tmp_path}/dead").collect()
    assert len(letters) == 3 and all(r["value"] for r in letters)


def test_state_has_parts_by_cores(spark, first, tmp_path):
    """Each part is opened and committed in every batch, also an empty one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        first.coalesce(1).write.json(f"{tmp_path}/in")
        parsed = ev.parse(ev.read_messages(spark, f"{tmp_path}/in")).filter("reason is null")
        latest.run(latest.latest_events(parsed, ["event_type"]), f"{tmp_path}/out", f"{tmp_path}/check")
        assert spark.conf.get("spark.sql.shuffle.partitions") == "50"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    parts = [p for p in (tmp_path / "check" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == 2 * spark.sparkContext.defaultParallelism
    found = latest.latest_of(spark.read.parquet(f"{tmp_path}/out")).collect()
    assert {r["document_id"]: r["event_type"] for r in found}["c"] == "document_delete"
