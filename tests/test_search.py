import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.operators import search
from quillmere.session import shared_dir


def frames(spark, questions, vectors, labels=None, ids=None):
    q = spark.createDataFrame(
        [(i, v.tolist(), f"l{i % 3}" if i % 2 else None) for i, v in enumerate(questions)],
        "question_id long, embedding array<float>, wanted string",
    )
    ids = ids or list(range(len(vectors)))
    v = spark.createDataFrame(
        [(ids[i], x.tolist(), f"l{i % 3}") for i, x in enumerate(vectors)],
        f"id {'string' if isinstance(ids[0], str) else 'long'}, embedding array<float>, label string",
    ).repartition(5)
    return q, v


def brute(questions, vectors, k, ids=None, allowed=lambda q, i: True):
    def unit(m):
        m = m.astype(np.float32).astype(np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    ids = ids or list(range(len(vectors)))
    scores = np.round(unit(questions) @ unit(vectors).T, 6)
    return {
        q: [(ids[i], scores[q, i]) for i in sorted(
            (i for i in range(len(vectors)) if allowed(q, i)), key=lambda i: (-scores[q, i], ids[i]))[:k]]
        for q in range(len(questions))
    }


def collected(hits):
    out = {}
    for r in hits.orderBy("question_id", "rank").collect():
        out.setdefault(r["question_id"], []).append((r["vector_id"], pytest.approx(r["score"])))
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(400, 8))
    vectors[100:230] = vectors[7]  # a third of the rows are copies
    vectors[300] = 0
    return rng.normal(size=(9, 8)), vectors


def test_exact(spark, data):
    questions, vectors = data
    questions[3] = vectors[7]
    q, v = frames(spark, questions, vectors)
    assert collected(search.top_k(q, v, 6)) == brute(questions, vectors, 6)


def test_string_ids(spark, data):
    questions, vectors = data
    ids = [f"c{i}" for i in range(len(vectors))]
    q, v = frames(spark, questions, vectors, ids=ids)
    assert collected(search.top_k(q, v, 3)) == brute(questions, vectors, 3, ids)


def test_many_blocks_and_tiles(spark, data, monkeypatch):
    questions, vectors = data
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 8 * 2)  # two questions per block
    monkeypatch.setattr(search, "TILE_CELLS", 20)
    q, v = frames(spark, questions, vectors)
    assert collected(search.top_k(q, v, 4)) == brute(questions, vectors, 4)


def test_one_scan_at_twenty_blocks(spark, data, monkeypatch):
    """However many blocks of questions there are, the vectors are read once
    and the questions are not brought to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    questions, vectors = np.random.default_rng(4).normal(size=(60, 8)), data[1]
    monkeypatch.setattr(search, "BLOCK_BYTES", 8 * 8 * 3)
    monkeypatch.setattr(search, "HELD_BYTES", 2000)  # several stretches of vectors to a task
    q, v = frames(spark, questions, vectors)
    path = shared_dir(spark, "vectors")
    v.write.parquet(path)
    brought, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: brought.append(collect(self)) or brought[-1])
    for name in ("toArrow", "toPandas", "toLocalIterator"):
        monkeypatch.setattr(DataFrame, name, None)
    found = search.top_k(q, spark.read.parquet(path), 4)
    assert sum(map(len, brought)) == 1  # a row per length of question
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("MapInArrow") == 1
    monkeypatch.undo()
    assert collected(found) == brute(questions, vectors, 4)


def test_equal_vectors_tie_wherever_they_lie(spark, monkeypatch):
    """Copies in batches of other sizes have one score, so the lowest ids win."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(search, "TILE_CELLS", 700)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        base = rng.normal(size=(40, 33))
        vectors = np.concatenate([base[rng.permutation(40)[:n]] for n in (40, 13, 39, 1, 27, 40, 5)])
        q, v = frames(spark, rng.normal(size=(25, 33)), vectors)
        got = search.top_k(q, v, 30).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = {}
    for r in got:
        key = r["question_id"], vectors[r["vector_id"]].tobytes()
        seen.setdefault(key, []).append(r)
    assert all(len({r["score"] for r in rows}) == 1 for rows in seen.values())
    for rows in seen.values():
        copies = [i for i, x in enumerate(vectors) if x.tobytes() == vectors[rows[0]["vector_id"]].tobytes()]
        assert sorted(r["vector_id"] for r in rows) == copies[: len(rows)]


def test_more_values_than_are_pushed(spark, data, monkeypatch):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    wanted = brute(questions, vectors, 5, allowed=lambda q, i: i % 3 == q % 3)
    asked = q.withColumn("wanted", F.concat(F.lit("l"), F.col("question_id") % 3))
    for values in (1, 1000):
        monkeypatch.setattr(search, "PUSHED_VALUES", values)
        assert collected(search.top_k(asked, v, 5, match={"label": "wanted"})) == wanted


def test_per_question_filter(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    wanted = brute(questions, vectors, 5, allowed=lambda q, i: q % 2 == 0 or i % 3 == q % 3)
    assert collected(search.top_k(q, v, 5, match={"label": "wanted"})) == wanted


def test_threshold_comes_after_the_cut(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    every = brute(questions, vectors, 5)
    got = collected(search.top_k(q, v, 5, threshold=0.8))
    assert got == {k: kept for k, rows in every.items() if (kept := [r for r in rows if r[1] >= 0.8])}


def test_no_questions(spark, data):
    q, v = frames(spark, *data)
    assert search.top_k(q.limit(0), v, 5).count() == 0


def test_wrong_dimension_is_left_out(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    more = v.unionByName(spark.createDataFrame([(999, [1.0], "l0"), (998, None, "l0")], v.schema))
    assert collected(search.top_k(q, more, 2)) == brute(questions, vectors, 2)


def test_cells_find_the_neighbours(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    questions = vectors.select(F.col("id").alias("question_id"), "embedding")
    centers = search.train_cells(vectors, cells=8, iterations=5)
    indexed = search.assign_cells(vectors, centers)
    exact = search.top_k(questions, vectors, 5).select("question_id", "vector_id")
    every = search.search_cells(questions, indexed, centers, 5, nprobe=8).select("question_id", "vector_id")
    assert exact.exceptAll(every).count() == 0
    near = search.search_cells(questions, indexed, centers, 5, nprobe=6).select("question_id", "vector_id")
    assert near.intersect(exact).count() / exact.count() >= 0.9


def test_bad_numbers_take_no_place(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    bad = [(900, [float("nan")] * 8, "l0"), (901, [1.0] * 7 + [None], "l0"), (902, [float("inf")] + [0.0] * 7, "l0"), (903, [], "l0")]
    more = v.unionByName(spark.createDataFrame(bad, v.schema))
    assert collected(search.top_k(q, more, 5)) == brute(questions, vectors, 5)
    some = q.select("question_id", F.when(F.col("question_id") % 2 == 0, F.col("embedding")).otherwise(
        F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).alias("embedding"))
    wanted = {k: r for k, r in brute(questions, vectors, 5).items() if k % 2 == 0}
    assert collected(search.top_k(some, v, 5)) == wanted


def test_questions_of_other_lengths(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    long = spark.createDataFrame([(77, [1.0] * 9)], "question_id long, embedding array<double>")
    both = q.select(F.col("question_id").cast("long").alias("question_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    wide = spark.createDataFrame([(500, [2.0] * 9, "l0")], v.schema)
    got = collected(search.top_k(both.unionByName(long), v.unionByName(wide), 5))
    assert got.pop(77) == [(500, 1.0)] and got == brute(questions, vectors, 5)
    assert 77 not in collected(search.top_k(both.unionByName(long), v.unionByName(wide), 5, dimension=8))


def test_limits_of_each_question(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    asked = q.withColumn("n", F.col("question_id") % 4 + 1).withColumn("least", F.when(F.col("question_id") % 2 == 0, F.lit(0.5)))
    every = brute(questions, vectors, 4)
    wanted = {
        k: kept for k, rows in every.items()
        if (kept := [r for r in rows[: k % 4 + 1] if k % 2 or r[1] >= 0.5])
    }
    assert collected(search.top_k(asked, v, k="n", threshold="least")) == wanted


def test_cells_of_zero_and_odd_vectors(spark, data):
    questions, vectors = data
    q, v = frames(spark, questions, vectors)
    odd = v.unionByName(spark.createDataFrame([(900, [0.0] * 8, "l0"), (901, [1.0], "l0"), (902, None, "l0"), (903, [float("nan")] * 8, "l0")], v.schema))
    centers = search.train_cells(odd, cells=4, iterations=3)
    indexed = search.assign_cells(odd, centers)
    got = collected(search.search_cells(q, indexed, centers, 5, nprobe=4))
    assert got == collected(search.top_k(q, odd, 5))


def test_further_cells_make_it_exact(spark, data):
    """One near cell each, then those that the triangle inequality leaves."""
    questions, vectors = data
    questions = np.concatenate([questions, np.zeros((1, 8)), vectors[7:8]])
    q, v = frames(spark, questions, vectors)
    odd = v.unionByName(spark.createDataFrame([(900, [0.0] * 8, "l0"), (901, [1.0], "l0"), (902, None, "l0"), (903, [float("nan")] * 8, "l0")], v.schema))
    centers = search.train_cells(odd, cells=12, iterations=3)
    path = shared_dir(spark, "cells")
    search.write_cells(search.assign_cells(odd, centers), path)
    indexed = spark.read.parquet(path)
    reach = search.cell_reach(indexed, centers)
    assert reach.agg(F.sum("n"), F.sum("zeros")).first()[:] == (401, 2)
    for options in ({"k": 5}, {"k": 300}, {"k": 5, "threshold": 0.6}, {"k": 5, "match": {"label": "wanted"}}):
        options = dict(options)
        k = options.pop("k")
        got = collected(search.search_cells(q, indexed, centers, k, nprobe=1, reach=reach, **options))
        assert got == collected(search.top_k(q, odd, k, **options))


def test_far_cells_are_not_read(spark):
    rng = np.random.default_rng(3)
    spots = np.eye(6)
    vectors = np.repeat(spots, 50, axis=0) + rng.normal(size=(300, 6)) * 0.02
    q, v = frames(spark, spots[:2] + 0.01, vectors)
    indexed = search.assign_cells(v, spots)
    reach = search.cell_reach(indexed, spots)
    path = shared_dir(spark, "cells")
    search.write_cells(indexed, path)
    for cell in range(2, 6):
        for file in glob.glob(f"{path}/cell={cell}/*.parquet"):
            with open(file, "wb") as broken:
                broken.write(b"no parquet")
    stored = spark.read.schema(indexed.schema).parquet(path)
    assert collected(search.search_cells(q, stored, spots, 5, nprobe=1, reach=reach)) == brute(spots[:2] + 0.01, vectors, 5)


def test_large_cells_are_split(spark, data):
    _, vectors = data
    _, v = frames(spark, data[0], vectors)
    centers = search.train_cells(v, cells=3, iterations=3, most_rows=100)
    sizes = [r["count"] for r in search.assign_cells(v, centers).groupBy("cell").count().collect()]
    assert len(centers) > 3 and max(sizes) < 250 and sum(sizes) == len(vectors)


def test_recall_of_the_registered_cells(spark):
    """The bounded form in the settings of the query: 32 cells, 20 of them
    looked into, every vector as a question."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumnRenamed("vec_id", "id")
    questions = vectors.select(F.col("id").alias("question_id"), "embedding")
    centers = search.train_cells(vectors, cells=32, iterations=5)
    exact = search.top_k(questions, vectors, 10).select("question_id", "vector_id")
    near = search.search_cells(questions, search.assign_cells(vectors, centers), centers, 10, nprobe=20)
    recall = near.select("question_id", "vector_id").intersect(exact).count() / exact.count()
    assert recall >= 0.9, recall


def test_a_scan_makes_few_vectors_ready_at_once(spark, tmp_path, monkeypatch):
    """What is held counts as it is multiplied, and a large batch is worked on in parts."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from quillmere.operators import search

    monkeypatch.setattr(search, "HELD_BYTES", 1 << 20)
    width, rows = 64, 100_000
    flat = pa.array(np.random.default_rng(1).random(width * rows, np.float32))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(rows)]), vectors], names=["vector_id", "embedding"])
    scan = search._scanner(search._Asked(str(tmp_path), [(width, 1)], 0, 1), [], None, pa.schema([]))
    tracemalloc.start()
    try:
        assert list(scan(iter([batch]))) == []  # the block has no questions
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 20 << 20  # all as doubles are 51 MB
