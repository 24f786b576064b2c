from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions import joins
from quillmere.operators import (
    analytics, answering, chunk_store, cleaning, curation, ingestion, lake, monitoring, quality, response_cache,
)
from quillmere.session import setting_bytes, shared_dir
from quillmere.streaming.events import numbered


@pytest.mark.parametrize("seed", range(6))
def test_median_of_many_values(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.round(rng.normal(size=int(rng.integers(1, 4000))), seed % 3)
    if seed == 4:
        values[: len(values) // 3] = 0.5  # a hot value
    if seed == 5:
        values = np.concatenate([np.zeros(500), np.ones(500)])  # the middle ranks differ
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert cleaning.exact_median(frame.repartition(5), "x") == pytest.approx(float(np.median(values)))


def test_filling_keeps_types_and_keys(spark):
    big = 2**53
    rows = [(big + i, i if i != 3 else None, i if i % 2 else None, float(i) if i else None, None) for i in range(8)]
    frame = spark.createDataFrame(rows, "id long, whole int, half int, x double, n int")
    got = cleaning.fill_numeric_with_median(frame, keys=["id"])
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint", "int", "int", "double", "int"]
    assert sorted(r["id"] for r in got.collect()) == [big + i for i in range(8)]
    assert {r["id"] - big: r["whole"] for r in got.collect()}[3] == 4 and got.filter("n is not null").count() == 0
    assert got.filter("id % 2 = 0").select("half").distinct().collect()[0][0] == 4
    odd = cleaning.fill_numeric_with_median(spark.createDataFrame([(1,), (2,), (None,)], "v int"))
    assert sorted(r["v"] for r in odd.collect()) == [1.0, 1.5, 2.0]


def test_large_keys_survive_the_etl(spark):
    from quillmere.plans import lake_etl

    rows = spark.createDataFrame([(2**53 + i, f"text {i} " * 20) for i in range(3)], "id long, text string")
    responses, report = lake_etl.run(spark, shared_dir(spark, "etl"), {"src": (rows, "id")}, datetime(2024, 1, 1))
    assert len({r["document_id"] for r in responses.collect()}) == 3
    assert all(str(2**53 + i) in "".join(r["document_id"] for r in responses.collect()) for i in range(3))


def test_process_table_order(spark):
    frame = spark.createDataFrame(
        [(1.0, " A "), (1.0, " A "), (None, None), (4.0, "b"), (10.0, "C")], "x double, t string"
    )
    got = {(r["x"], r["t"]) for r in cleaning.process_table(frame, "now").collect()}
    assert got == {(1.0, "a"), (4.0, ""), (4.0, "b"), (10.0, "c")}  # the median is taken after the copies are gone


def test_duplicates_with_maps(spark):
    rows = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (1, {"b": "2", "a": "1"}), (1, {"a": "2"})], "i int, m map<string,string>")
    assert cleaning.drop_duplicate_rows(rows).count() == 2


def test_profile_of_an_empty_table(spark):
    row = quality.profile_table(spark.createDataFrame([], "a int, b string"), "t").first()
    assert row["row_count"] == 0 and row["null_percentage"] is None and row["duplicate_rows"] == 0
    assert quality.gate_tables(quality.profile_table(spark.createDataFrame([], "a int"), "t")).first()["passed"] is False


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_keys_do_not_change_a_join(spark, how):
    left = spark.range(3000).select("id", F.when(F.col("id") < 1000, 1).otherwise(F.col("id") % 500).alias("k"))
    left = left.unionByName(spark.range(500).select((F.col("id") + 9000).alias("id"), F.lit(None).cast("long").alias("k")))
    right = spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    plain = left.join(right, ["k"], how)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joins.hot_keys(left, ["k"], share=0.1).collect()[0]["k"] == 1
        dealt = joins.skew_join(left, right, ["k"], how, spread=["id"])
        assert dealt.count() == plain.count() and dealt.select(plain.columns).exceptAll(plain).count() == 0
        assert "_salt" in dealt._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("text", "size"), [("10485760b", 10485760), ("10MB", 10 << 20), ("-1", -1), ("5k", 5120)])
def test_byte_settings(spark, text, size):
    spark.conf.set("quillmere.test", text)
    assert setting_bytes(spark, "quillmere.test") == size


def test_numbering_across_blocks(spark):
    rows = spark.createDataFrame([("a", i * 3) for i in range(50)] + [("b", 7)], "g string, o long").repartition(6)
    got = numbered(rows, "g", "o", block=10).orderBy("g", "o").collect()
    assert [r["position"] for r in got] == [*range(50), 0]


def test_curation_drops_rows_without_long_text(spark):
    rows = spark.createDataFrame([(1, "x" * 51, "s"), (2, "short", "s")], "k int, body string, tag string")
    got = curation.curate_rows(rows, "k").collect()
    assert [(r["document_id"], r["content"], r["metadata"]) for r in got] == [
        ("doc_1", "body: " + "x" * 51, {"k": "1", "tag": "s"})
    ]


def test_requests_need_exactly_one_input(spark):
    rows = spark.createDataFrame([("u", None), (None, "c"), (None, None), ("u", "c")], "file_url string, file_content string")
    assert [r["error"] is None for r in curation.check_requests(rows).collect()] == [False, True, False, False]


def test_insert_if_absent_takes_one_of_several(spark):
    table = spark.createDataFrame([(1, "a")], "k int, v string")
    rows = spark.createDataFrame([(1, "z"), (2, "c"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, ingestion.insert_if_absent(table, rows, "k").collect())) == [(1, "a"), (2, "b")]


def chunk_rows(spark, *pairs):
    return spark.createDataFrame(
        [(f"{d}_chunk_0", d, 0, text, None, {"title": d}) for d, text in pairs], chunk_store.CHUNKS
    )


def test_chunk_store(spark):
    path = shared_dir(spark, "t")
    chunk_store.create(spark, path)
    step = lambda n: chunk_store.begin(spark, path, "test", n)
    ids = chunk_store.insert(chunk_rows(spark, ("a", "1"), ("b", "1"), ("c", "1")), path, step(1))
    assert sorted(r["id"] for r in ids.collect()) == ["a_chunk_0", "b_chunk_0", "c_chunk_0"]
    doc = lambda d: spark.createDataFrame([(d,)], "document_id string")
    change = spark.createDataFrame(
        [("a", {"title": "old"}, "1"), ("a", {"title": "new"}, "2"), ("b", {"x": "y"}, "1")],
        "document_id string, metadata map<string,string>, sequence string",
    )
    chunk_store.change_metadata(change, path, step(2))
    chunk_store.replace(chunk_rows(spark, ("b", "2")), doc("b"), path, step(3))
    chunk_store.remove(doc("c"), path, step(4))
    chunk_store.remove(doc("unknown"), path, step(5))

    def seen(where):
        return {r["document_id"]: (r["content"], r["metadata"]) for r in chunk_store.current(spark, where).collect()}

    wanted = {"a": ("1", {"title": "new"}), "b": ("2", {"title": "b"})}
    assert seen(path) == wanted
    chunk_store.replace(chunk_rows(spark, ("b", "2")), doc("b"), path, step(3))  # the same change again
    assert seen(path) == wanted
    target = shared_dir(spark, "t")
    chunk_store.compact(spark, path, target)
    assert seen(target) == wanted
    # another writer with the same batch numbers adds to the compacted store
    other = chunk_store.begin(spark, target, "other", 0)
    chunk_store.insert(chunk_rows(spark, ("d", "1")), target, other)
    assert other.version == 2 and other == chunk_store.begin(spark, target, "other", 0)
    assert seen(target) == wanted | {"d": ("1", {"title": "d"})}
    assert chunk_store.begin(spark, target, "third", 0).version == 3
    chunk_store.create(spark, target)  # a store that is there stays
    assert len(seen(target)) == 3
    counts = chunk_store.deleted_counts(chunk_store.current(spark, path), doc("a").union(doc("zz")))
    assert {r["document_id"]: r["deleted"] for r in counts.collect()} == {"a": 1, "zz": 0}


def test_a_removal_reads_its_buckets_only(spark):
    """Files of other buckets may be unreadable, and the plan names the buckets."""
    import glob

    path = shared_dir(spark, "t")
    chunk_store.create(spark, path, buckets=64)
    names = [f"d{i}" for i in range(1000)]
    chunk_store.insert(chunk_rows(spark, *[(n, "x") for n in names]), path, chunk_store.begin(spark, path, "t", 1))
    asked = spark.createDataFrame([(n,) for n in [*names[:10], "unknown"]], "document_id string")
    buckets = set(chunk_store.buckets_of(asked, path))
    assert 1 < len(buckets) <= 11
    for file in glob.glob(f"{path}/chunks/version=1/*/bucket=*/*.parquet"):
        if int(file.split("bucket=")[1].split("/")[0]) not in buckets:
            with open(file, "wb") as broken:
                broken.write(b"no parquet")
    chunk_store.remove(asked, path, chunk_store.begin(spark, path, "t", 2))
    removed = spark.read.parquet(f"{path}/removed").filter("version = 2")
    assert sorted(r["document_id"] for r in removed.collect()) == sorted(names[:10])
    counts = chunk_store.stored_counts(asked, path).collect()
    assert {r["document_id"]: r["deleted"] for r in counts} == dict.fromkeys([*names[:10], "unknown"], 0)
    plan = chunk_store.known_documents(asked, path)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [bucket" in line and "ReadSchema: struct<document_id:string>" in line for line in scans)
    with pytest.raises(Exception, match="no parquet|is not a Parquet file"):
        chunk_store.current(spark, path).count()


def test_writers_at_once_get_versions_of_their_own(spark):
    from concurrent.futures import ThreadPoolExecutor

    path = shared_dir(spark, "t")
    chunk_store.create(spark, path)
    with ThreadPoolExecutor(8) as pool:
        given = list(pool.map(lambda k: chunk_store.begin(spark, path, f"w{k}", k % 3), range(40)))
    assert len({c.version for c in given}) == 40
    assert [chunk_store.begin(spark, path, f"w{k}", k % 3) for k in range(40)] == given
    rows = [chunk_rows(spark, (f"d{k}", "x"), ("shared", str(k))) for k in (0, 1)]
    doc = spark.createDataFrame([("shared",)], "document_id string")
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda k: chunk_store.replace(rows[k], doc, path, given[k]), (0, 1)))
    seen = {r["document_id"]: r["content"] for r in chunk_store.current(spark, path).collect()}
    assert seen["d0"] == seen["d1"] == "x" and seen["shared"] in "01"


def test_store_takes_odd_ids(spark):
    """Null ids, repeated rows, an empty change, and another number of buckets."""
    path, target = shared_dir(spark, "t"), shared_dir(spark, "t")
    chunk_store.create(spark, path, buckets=3)
    rows = chunk_rows(spark, (None, "n"), ("", "e"), ("a/b=c", "s"), ("twice", "1"), ("twice", "1"))
    chunk_store.insert(rows, path, chunk_store.begin(spark, path, "t", 1))
    none = spark.createDataFrame([], "document_id string")
    chunk_store.replace(rows.limit(0), none, path, chunk_store.begin(spark, path, "t", 2))
    seen = lambda where: sorted((str(r[0]), r[1]) for r in chunk_store.current(spark, where).select("document_id", "content").collect())
    wanted = sorted([("None", "n"), ("", "e"), ("a/b=c", "s"), ("twice", "1"), ("twice", "1")])
    assert seen(path) == wanted
    chunk_store.compact(spark, path, target, buckets=7)
    assert seen(target) == wanted and chunk_store.bucket_count(spark, target) == 7
    gone = spark.createDataFrame([("twice",), ("a/b=c",), (None,), ("twice",)], "document_id string")
    chunk_store.remove(gone, target, chunk_store.begin(spark, target, "t", 1))
    assert seen(target) == sorted([("None", "n"), ("", "e")])  # a null id names no document


def test_lake(spark):
    root, now = shared_dir(spark, "lake"), datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        lake.store(spark.range(1), root, "nowhere", "k", now)
    summary = lake.land(spark.range(2500).repartition(1), root, "src", now, batch_size=1000)
    assert summary["records_ingested"] == 2500
    raw = spark.read.parquet(f"{root}/raw/src/*")
    assert raw.select("_metadata.file_path").distinct().count() == 3
    lines = spark.createDataFrame([("a b",), ("c",)], "value string").coalesce(1)
    lake.store(lines, root, "documents", "notes/x", now, fmt="text", tags=["n"], source="me")
    assert lake.load(spark, root, "documents", "notes/x", "text").first()["value"] == "a b\nc\n"
    listed = lake.list_assets(lake.catalog(spark, root), prefix="notes/", tags=["n", "other"]).collect()
    assert [(r["zone"], r["format"], r["size_bytes"], r["source"]) for r in listed] == [("documents", "text", 6, "me")]
    lake.store(lines.limit(1), root, "documents", "notes/x", now, fmt="text", source="again")  # one row a key
    listed = lake.list_assets(lake.catalog(spark, root), prefix="notes/").collect()
    assert [(r["size_bytes"], r["source"]) for r in listed] == [(4, "again")]
    gone = spark.createDataFrame([("documents", "notes/x"), ("raw", "unknown")], "zone string, key string")
    assert lake.delete_stored(spark, root, gone, datetime(2024, 1, 2)) == 1
    assert lake.catalog(spark, root).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        lake.load(spark, root, "documents", "notes/x", "text").count()
    bad = spark.range(3).select(F.raise_error(F.lit("broken")).cast("string").alias("v"))
    summary = lake.land(bad, root, "src", now)
    assert summary["status"] == "failed" and "broken" in summary["error"]


def test_refresh_replaces_the_report(spark):
    path = shared_dir(spark, "view")
    for n in (3, 5):
        view = analytics.refresh(spark.range(n).agg(F.count("*").alias("n")), path)
        assert [r["n"] for r in view.collect()] == [n]


def test_refreshed_dashboard_equals_the_view(spark):
    """Refreshes at uneven moments, late rows, a repeated one, users that come
    again, an empty log."""
    from datetime import timedelta

    root, start = shared_dir(spark, "dashboard"), datetime(2024, 1, 1)
    shape = "user_id string, response_time_ms int, created_at timestamp_ntz"
    rows = [
        (None if k % 11 == 0 else f"u{k % 7}", None if k % 5 == 0 else k, start + timedelta(minutes=17 * k, seconds=k % 60)) for k in range(400)
    ]
    documents = spark.createDataFrame([("completed", 3), ("pending", 9)], "status string, chunk_count int")
    moments = [start + timedelta(hours=h, minutes=m) for h, m in ((0, 0), (20, 30), (20, 30), (20, 59), (24, 0), (51, 7), (113, 0), (150, 0))]
    for moment in moments:
        # every ninth row shows up only forty minutes after its time
        there = [r for k, r in enumerate(rows) if r[2] + timedelta(minutes=40 if k % 9 == 0 else 0) <= moment]
        logs = spark.createDataFrame(there, shape)
        got = analytics.refresh_dashboard(documents, logs, root, str(moment)).first().asDict()
        assert got == analytics.dashboard_metrics(documents, logs, str(moment)).first().asDict()
    plan = analytics.refresh_dashboard(documents, logs, root, str(moments[-1]))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_invalidation_unfolds_no_entry(spark):
    path, now = shared_dir(spark, "citations"), datetime(2024, 1, 1)
    shape = "cache_key string, query string, response string, source_documents array<string>, created_at timestamp_ntz, expires_at timestamp_ntz"
    entry = lambda key, day, *ids: (key, "q", "r", list(ids), datetime(2024, 1, day), now)
    old = spark.createDataFrame([entry("a", 1, "d1", "d2"), entry("b", 1, "d2"), entry("c", 1), entry("d", 1, "d3", "d3")], shape)
    new = spark.createDataFrame([entry("b", 2, "d4")], shape)
    for fresh in (old, new):
        response_cache.append_citations(fresh, path)
    cache = response_cache.upsert(old, new)
    gone = spark.createDataFrame([("d2",), ("d3",), ("none",)], "document_id string")
    left = response_cache.invalidate_documents(cache, gone, response_cache.read_citations(spark, path, gone))
    assert sorted(r["cache_key"] for r in left.collect()) == ["b", "c"] and left.columns == cache.columns
    assert "explode(source_documents" not in left._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["cache_key"] for r in response_cache.invalidate_documents(cache, gone).collect()) == ["b", "c"]


def test_template_answer(spark):
    def run(context, question):
        frame = spark.createDataFrame([(context, question)], "c string, q string")
        return frame.select(answering.template_answer(answering.prompt(F.col("c"), F.col("q")))).first()[0]

    assert run("x" * 200, "What IS it?") == (
        "Based on the provided context, what is it?\n\nanswer: can be answered using the information about " + "x" * 100 + "..."
    )
    assert run("", "q") == answering.UNCLEAR
    assert run("Context: y", "q") == answering.UNCLEAR  # the text mark inside the context ends it


def test_questions_without_sources(spark):
    questions = spark.createDataFrame([(1, "q")], "question_id long, query string")
    sources = spark.createDataFrame([], "question_id long, vector_id string, score double, rank int, content string")
    row = answering.answer(questions, sources).first()
    assert (row["answer"], row["confidence_score"], row["source_ids"]) == (answering.NO_SOURCES, 0.0, [])


def test_request_rules(spark):
    rows = spark.createDataFrame(
        [(" q ", None, None), ("  ", 5, 0.5), ("x" * 1001, 5, 0.5), ("q", 21, 0.5), ("q", 20, 1.5)],
        "query string, max_results int, similarity_threshold double",
    )
    got = answering.validate_requests(rows).collect()
    assert [r["valid"] for r in got] == [True, False, False, False, False]
    assert (got[0]["query"], got[0]["max_results"], got[0]["similarity_threshold"]) == ("q", 5, 0.7)


def test_a_popular_question_is_answered_once(spark):
    requests = spark.createDataFrame([(str(i), "same") for i in range(30)], "request_id string, query string")
    cache = spark.createDataFrame(
        [], "cache_key string, query string, response string, source_documents array<string>, created_at timestamp_ntz, expires_at timestamp_ntz"
    )
    asked = []

    def answer_misses(rows):
        asked.append(rows.count())
        return rows.select("cache_key", "query", F.lit("r").alias("response"), F.array(F.lit("d")).alias("source_documents"))

    answers, after = response_cache.answer_with_cache(requests, cache, answer_misses, "2024-01-01 00:00:00")
    assert asked == [1] and answers.count() == 30 and answers.filter("cached").count() == 0
    again, _ = response_cache.answer_with_cache(requests, after, answer_misses, "2024-01-01 00:59:59")
    assert again.filter("cached").count() == 30
    late, _ = response_cache.answer_with_cache(requests, after, answer_misses, "2024-01-01 01:00:00")
    assert late.filter("cached").count() == 0
    assert response_cache.clear(after).count() == 0


@pytest.mark.parametrize(
    ("errors", "times", "status"),
    [(0, [10] * 100, "healthy"), (0, [4000] * 100, "degraded"), (0, [6000] * 30 + [10] * 70, "warning"),
     (8, [10] * 100, "warning"), (11, [10] * 100, "critical")],
)
def test_health(spark, errors, times, status):
    now = datetime(2024, 1, 1)
    logs = spark.createDataFrame([(i, now, t) for i, t in enumerate(times)], "id int, created_at timestamp, response_time_ms int")
    assert monitoring.health(logs, spark.range(errors)).first()["status"] == status


def test_empty_log(spark):
    logs = spark.createDataFrame(
        [], "id int, created_at timestamp_ntz, response_time_ms int, cached boolean, num_results int, confidence_score double"
    )
    row = monitoring.metrics_summary(logs, "2024-01-01 00:00:00").first()
    assert row["total_queries"] == 0 and row["query_rate_per_second"] == 0.0 and row["average_confidence_score"] == 0.0
