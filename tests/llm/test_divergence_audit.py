"""Skybands against all comparisons, and the audit against a plain version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from quillmere.llm import divergence_audit as audit

ROWS = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source", "term", "n", "part", "total")])


def documents(spark, rows):
    """(text, lang, source) with further columns whose names are used inside."""
    return spark.createDataFrame([(*r, "x", None, "y", "z") for r in rows], ROWS).repartition(3)


def plain(rows, min_docs, top):
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) for t, _, _ in rows]
    groups = [(l or "", s or "") for _, l, s in rows]
    docs, lang_n, n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for (lang, source), own in zip(groups, terms):
        docs[lang].update(set(own))
        lang_n[lang].update(own)
        n[lang, source].update(own)
    kept = {l: sorted(t for t, k in docs[l].items() if k >= min_docs) for l, _ in groups}

    def shares(count, names):
        total = sum(count[t] for t in names)
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(names)) for t in names}

    of = {g: shares(n[g], kept[g[0]]) for g in set(groups)}
    out = []
    for lang, source in of:
        p, q = of[lang, source], shares(lang_n[lang], kept[lang])
        pairs = [(-sum(abs(p[t] - r[t]) for t in p), s) for (l, s), r in of.items() if l == lang and s != source]
        over = [(q[t] - p[t], t) for t in p if n[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", over)):
            found.sort(key=lambda x: (x[0], x[1].encode()))
            found = found if part == "pair" else found[:top]
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6)), max_size=120), st.integers(1, 8), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_dominated(points, k, stride):
    counts, langs = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
    names = np.random.default_rng(1).permutation(len(points))
    before, audit.STRIDE = audit.STRIDE, stride
    try:
        got = audit.dominated(counts, langs, names, k)
    finally:
        audit.STRIDE = before
    by = [sum(counts[j] >= counts[i] and langs[j] <= langs[i] and names[j] < names[i] for j in range(len(points))) for i in range(len(points))]
    assert got.tolist() == [b >= k for b in by]


def _rows(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["été", "日本", "Straße", "ÉTÉ", "x_y", "a1b"]
    rows = []
    for k in range(300):
        size = int(rng.integers(0, 30))
        at = (rng.zipf(1.4, size) + int(rng.integers(0, 4))) % len(vocabulary)
        text = rng.choice([" ", "\n", "-", "7"]).join(vocabulary[i].upper() if k % 5 == 0 else vocabulary[i] for i in at)
        rows.append((text, ["de", "en", None][k % 3], f"src{int(rng.integers(0, 4))}"))
    return rows + [
        (None, "en", "src9"), ("", "en", None), ("!! 12", "xx", "only"), ("rare words", "yy", "a"), ("rare words", "yy", "b"),
        (None, None, None), ("wa " * 5000, "de", "src0"), ("same", "zz", "s"), *[("same tie", "tt", s) for s in "abc" * 12],
    ]


@pytest.mark.parametrize("small", [False, True])
def test_audit(spark, monkeypatch, small):
    if small:  # several parts to a skyband, several blocks to a language, rounds of merging
        monkeypatch.setattr(audit, "PART_TERMS", 7)
        monkeypatch.setattr(audit, "BLOCK_TERMS", 3)
        monkeypatch.setattr(audit.skybands, "__defaults__", (audit.TOP, 7))
    rows = _rows(1)
    got = audit.audit(documents(spark, rows), min_docs=5, top=6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 5, 6)


def test_skybands_lose_nothing_and_thin(spark):
    rng = np.random.default_rng(2)
    data = [("en", "s", f"t{i:05d}", int(rng.zipf(1.3) % 1000 + 1), int(rng.integers(1, 2000))) for i in range(4000)]
    terms = spark.createDataFrame(data, "lang string, source string, term string, n long, lang_n long")
    band = {r["term"] for r in audit.skybands(terms, 5, 300).collect()}
    first = sorted(data, key=lambda r: (-(r[3] * 1000 - r[4]), r[2]))[:5]
    assert {r[2] for r in first} <= band and len(band) < 1000


def test_shares_are_exact_beyond_64_bits(spark):
    rows = [(10**14 + 7, 3 * 10**14, 10**6), (0, 10**15, 1), (9 * 10**12, 9 * 10**12, 1)]
    frame = spark.createDataFrame(rows, "n long, total long, n_terms long")
    got = [r[0] for r in frame.select(audit.share(F.col("n"), F.col("total"), F.col("n_terms"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in rows]


def test_empty(spark):
    assert audit.audit(documents(spark, []).limit(0)).count() == 0
