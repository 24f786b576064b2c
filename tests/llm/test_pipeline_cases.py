"""The pipeline's stages on nulls, blank and long texts, ties, repeated rows, empty tables and clashing names."""

import os

import corpus_pipeline
import pytest
from helpers import documents

from quillmere.session import shared_dir

ITEM = " ".join(f"item{i}" for i in range(40))
LONG = " ".join(f"l{i % 3001}x{i % 17}" for i in range(20_000))
BODY = [f"document {k} tells of {k * 7} things and of {k * k} more, in a plain order of words" for k in range(30)]


def tables(spark, docs, labels, benchmark):
    root = shared_dir(spark, "tables")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def stages(spark, root):
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, root).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


ROWS = [
    *((k, BODY[k]) for k in range(30)), (1000, BODY[3]), (1001, BODY[3] + " "), (1001, BODY[3]), (None, BODY[3]), (5, BODY[5]),
    (2000, None), (2001, ""), (2002, " \t\n"), (None, None), (None, "no id here"), (3000, LONG), (3001, LONG + " end"),
    (4000, "before " + ITEM + " behind"), (4001, None),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = documents(spark, ROWS)
    labels = [(k, 1, 0) for k in range(30)] + [(4000, None, 0), (None, 1, 1), (77, 0, None)]
    return docs, stages(spark, tables(spark, docs, labels, [(1, ITEM), (2, None), (3, "")]))


def test_columns_pass_through(found):
    docs, got = found
    for name in ("quality_classifier", "exact_dedup", "jaccard_join", "benchmark_decontamination"):
        assert got[name].dtypes == docs.dtypes


def test_rows_of_each_stage(found):
    docs, got = found
    rows = {name: [(r["doc_id"], r["text"]) for r in frame.collect()] for name, frame in got.items() if name != "best_fit_packing"}
    assert len(rows["quality_classifier"]) == len(ROWS)  # all labels are good: nothing is rejected
    exact = rows["exact_dedup"]
    assert (1001, BODY[3] + " ") in exact and sum((t or "").strip() == BODY[3] for _, t in exact) == 1
    assert [t for _, t in exact if not (t or "").strip()] == [" \t\n"]  # the longest of the blank ones
    assert sum(t == BODY[5] for _, t in exact) == 1
    near = rows["jaccard_join"]
    assert [d for d, t in near if t and t.startswith("l0x0")] == [3000]
    assert sum(not (t or "").strip() for _, t in near) == 1 and (None, "no id here") in near
    clean = rows["benchmark_decontamination"]
    assert set(near) - set(clean) == {(4000, "before " + ITEM + " behind")}
    packed = got["best_fit_packing"].collect()
    pieces = [(r["doc_id"], r["piece"]) for r in packed if r["piece"] == 0]
    assert sorted(map(str, pieces)) == sorted(str((d, 0)) for d, _ in clean)
    assert max(r["length"] for r in packed) <= 4096 and len([r for r in packed if r["doc_id"] == 3000]) > 1


@pytest.mark.parametrize("labels", [[], [(k, 1, 0) for k in range(30)]])
def test_empty_tables(spark, labels):
    root = tables(spark, documents(spark, ROWS[:3]).limit(0), labels, [])
    assert corpus_pipeline.run(spark, root).count() == 0
    root = tables(spark, documents(spark, ROWS[:3]), labels, [])
    got = corpus_pipeline.run(spark, root)
    assert got.count() in ((0, 3) if not labels else (3,))


def test_stage_tables_are_deleted(spark, monkeypatch):
    made, shared = [], corpus_pipeline.shared_dir
    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda *a: made.append(shared(*a)) or made[-1])
    root = tables(spark, documents(spark, ROWS[:3]), [(k, 1, 0) for k in range(30)], [])
    corpus_pipeline.run(spark, root)
    assert [os.path.exists(p) for p in made] == [False] * 4 + [True]
