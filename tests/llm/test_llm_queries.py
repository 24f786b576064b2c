"""Registered queries against their SQL, or against plain versions."""

import zlib

import numpy as np
import pandas as pd
import pytest
from helpers import linked_components, terms

from quillmere.llm import queries
from quillmere.llm.queries import QUERIES, SQL


def _plain(frame):
    """Sorted rows as text; numbers that a null made floats are whole again."""

    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return str(int(v)) if isinstance(v, (float, np.floating)) and float(v).is_integer() else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got, wanted = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(wanted.columns) and _plain(got) == _plain(wanted)


@pytest.fixture(scope="module")
def encoded(duck):
    from tokenizers import Tokenizer

    from quillmere.llm.tokens import default_tokenizer

    rows = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall()
    found = Tokenizer.from_file(default_tokenizer()).encode_batch([t for _, t in rows], add_special_tokens=False)
    return {d: np.array([*e.ids, 1], "<u4") for (d, _), e in zip(rows, found)}


def test_packing(spark, sf_dir, encoded):
    got = QUERIES["op1_best_fit_packing"](spark, sf_dir).toPandas()
    assert sorted(got["doc_id"].unique()) == sorted(encoded)
    for doc, some in got.groupby("doc_id"):
        ids, some = encoded[doc], some.sort_values("piece")
        assert some["piece"].tolist() == list(range(-(-len(ids) // 4096)))
        assert some["start"].tolist() == list(range(0, len(ids), 4096))
        for r in some.itertuples():
            part = ids[r.start : r.start + 4096]
            assert (r.length, r.ids_crc32) == (len(part), zlib.crc32(part.tobytes()))
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id")["length"].cumsum()
    assert (ends - placed["length"] == placed["offset"]).all() and ends.max() <= 4096
    least = -(-got["length"].sum() // 4096)
    assert got["sequence_id"].nunique() <= 1.05 * least + 1


def test_token_files(spark, sf_dir, encoded):
    got = QUERIES["op10_rans_token_files"](spark, sf_dir).toPandas().sort_values("doc_id")
    sizes = [len(encoded[d]) for d in sorted(encoded)]
    assert got["doc_id"].tolist() == sorted(encoded)
    assert got["n_tokens"].tolist() == sizes
    assert got["start"].tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(encoded[d].tobytes()) for d in sorted(encoded)]


def _held_out(frame, label):
    part = frame[frame["held_out"]]
    good = part[label] == 1
    ranks = part["score"].rank()
    n, m = good.sum(), (~good).sum()
    return (ranks[good].sum() - n * (n + 1) / 2) / (n * m), (good == (part["predicted"] == 1)).mean()


@pytest.mark.parametrize(
    "name, label, folds, fold, auc, right",
    [("op9_bradley_terry_quality", "quality", 5, 0, 0.97, 0.95), ("op3_toxic_segments", "toxic", 4, 2, 0.8, 0.93)],
)
def test_held_out(spark, duck, name, label, folds, fold, auc, right):
    labels = queries.table(spark, "/root/testdata/sf0.01", "labels").toPandas()
    got = QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % folds == fold)).all()
    area, share = _held_out(got.merge(labels, on="doc_id"), label)
    assert area >= auc and share >= right


def test_license_notices(spark, duck, sf_dir):
    from quillmere.llm.license_scan import NOTICES

    def runs(text):
        t = terms(text)
        return {tuple(t[i : i + 5]) for i in range(len(t) - 4)}

    wanted = set()
    for doc, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        own = runs(text)
        wanted |= {(doc, name) for name, notice in NOTICES if len(runs(notice) & own) >= 0.8 * len(runs(notice))}
    got = QUERIES["op4_license_notices"](spark, sf_dir).toPandas()
    assert wanted and set(zip(got["doc_id"], got["license_id"])) == wanted and len(got) == len(wanted)


def _leaks(duck):
    """Documents that hold at least half of an item's terms in runs of five, and no two runs of the item overlap there."""
    items = [(i, terms(t)) for i, t in duck.sql("SELECT item_id, text FROM benchmark").fetchall()]
    found = {}
    for doc, text in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        own = terms(text)
        runs = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        for item, t in items:
            covered = set()
            for i in range(len(t) - 4):
                if tuple(t[i : i + 5]) in runs:
                    covered |= set(range(i, i + 5))
            if t and len(covered) >= 0.5 * len(t):
                found[doc, item] = len(covered) / len(t)
    return found


def test_benchmark_tiling(spark, duck, sf_dir):
    got = QUERIES["op8_benchmark_tiling"](spark, sf_dir).toPandas()
    wanted = _leaks(duck)
    assert wanted and dict(zip(zip(got["doc_id"], got["item_id"]), got["coverage"])) == pytest.approx(wanted)


def test_pipeline_against_plain_versions(spark, duck, sf_dir):
    import re

    import corpus_pipeline
    from quillmere.llm import quality_ranking

    docs = queries.table(spark, sf_dir, "documents")
    scores = quality_ranking.score(docs, quality_ranking.fit(docs, queries.table(spark, sf_dir, "labels"))).toPandas()
    good = set(scores[scores["predicted"] == 1]["doc_id"])
    rows = [(d, t) for d, t in duck.sql("SELECT doc_id, coalesce(text, '') FROM documents ORDER BY doc_id").fetchall() if d in good]
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), d, t))
    rows = sorted((d, t) for _, d, t in (min(g) for g in groups.values()))
    label = linked_components([t for _, t in rows], 5, 80)
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    leaked = {d for d, _ in _leaks(duck)}
    wanted = {d for d, _ in rows} - leaked
    got = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert 0 < len(wanted) < len(scores) and set(got["doc_id"]) == wanted
