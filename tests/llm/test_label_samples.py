"""Fits on a bounded sample of the labels against fits on all of them."""

import random
import zlib

import pytest
from helpers import documents

from quillmere.llm import quality_ranking, toxicity


def test_toxicity_sample_keeps_the_ratio(spark):
    deal = random.Random(1)
    rows, marks = [], []
    for i in range(2000):
        toxic = i % 10 == 0
        said = ["vile"] * (2 if deal.random() < (0.7 if toxic else 0.03) else 0)
        rows.append((i, " ".join([*(f"w{deal.randrange(300)}" for _ in range(30)), *said])))
        marks.append((i, int(toxic)))
    rows += rows[::3]  # copies have one vote
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    whole, part = toxicity.fit(docs, labels), toxicity.fit(docs, labels, sample_rows=120)
    assert part.base == pytest.approx(whole.base, abs=0.6)
    scores = [toxicity.score(docs, m).select("doc_id", "score").distinct().toPandas()["score"] for m in (whole, part)]
    assert scores[1].mean() == pytest.approx(scores[0].mean(), abs=0.04)


def test_quality_sample_keeps_the_quantile(spark):
    deal = random.Random(2)
    rows, marks = [], []
    for i in range(2000):
        bad = i % 10 == 0
        junk = max(0, round(deal.gauss(14 if bad else 8, 3)))  # the kinds overlap
        said = [*(f"word{deal.randrange(300)}" for _ in range(40 - junk)), *["%%"] * junk]
        deal.shuffle(said)
        rows.append((i, " ".join(said)))
        marks.append((i, int(not bad)))
    docs, labels = documents(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")
    models = [quality_ranking.fit(docs, labels, sample_rows=n) for n in (20_000, 150)]
    shares = [1 - quality_ranking.score(docs, m).toPandas()["predicted"].mean() for m in models]
    assert 0.07 <= shares[0] <= 0.13 and shares[1] == pytest.approx(shares[0], abs=0.06)
    assert models[1].centre == pytest.approx(models[0].centre, abs=0.3 * models[0].scale.max())


def test_repeated_ids_train_once(spark, monkeypatch):
    """Rows that reach the driver, with one id that has most rows and many texts."""
    rows = [(i, f"a fair word {i} " * 9 if i % 2 else f"%% || {i} " * 30) for i in range(60)]
    rows += [(1, f"a fair text {i % 150} " * 9) for i in range(300)]
    marks = [(i, i % 2) for i in range(60)]
    seen = []
    inner = quality_ranking._feature_rows
    monkeypatch.setattr(quality_ranking, "_feature_rows", lambda docs: seen.append(docs.count()) or inner(docs))
    docs = documents(spark, rows)
    quality_ranking.fit(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    curve = toxicity._curve
    monkeypatch.setattr(toxicity, "_curve", lambda evidence, *rest: seen.append(len(evidence)) or curve(evidence, *rest))
    toxicity.fit(docs, labels)
    wanted = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(60))
    assert seen == [wanted, sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(60))]
