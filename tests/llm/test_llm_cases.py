"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names; and helpers against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import documents, linked_components, shingles, words
from hypothesis import given, settings, strategies as st

from quillmere.llm import (
    decontamination, exact_dedup, jaccard_join, license_scan, packing, quality_ranking, rans, substring_dedup,
    token_files, toxicity, warc,
)
from quillmere.session import shared_dir

LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (None, None), (5, LONG), (6, LONG + " end")]
PASSAGE = " ".join(f"p{i}" for i in range(40))


def empty(spark):
    return documents(spark, []).limit(0)


def test_packing_cases(spark):
    got = packing.pack_documents(documents(spark, ODD), capacity=512, open_bins=4).toPandas()
    assert len(got[got["doc_id"] == 4]) == 2 and got[got["doc_id"] == 1]["length"].tolist() == [1]
    placed = got.sort_values(["sequence_id", "offset"])
    ends = placed.groupby("sequence_id")["length"].cumsum()
    assert (ends - placed["length"] == placed["offset"]).all() and ends.max() <= 512
    assert packing.pack_documents(empty(spark)).count() == 0
    whole = packing.sequences(packing.pack(packing.cut_pieces(documents(spark, ODD), 512, with_ids=True), 512)).toPandas()
    assert sum(len(x) // 4 for x in whole["ids"]) == got["length"].sum()


@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_open_bins(lengths, most):
    bins, used, open_ = packing.OpenBins(50, most), {}, {}
    for n in lengths:
        fitting = [room for room in open_.values() if room >= n]
        chosen, offset = bins.place(n)
        assert offset == used.get(chosen, 0)
        if fitting:
            assert open_[chosen] == min(fitting)
        elif len(open_) == most:
            open_.pop(min(open_, key=lambda b: (open_[b], b != next((x for x in open_ if open_[x] == min(open_.values())), b))), None)
        used[chosen] = offset + n
        open_[chosen] = 50 - used[chosen]
        if not open_[chosen]:
            del open_[chosen]
        if len(open_) != bins.open:  # equally full bins: either may have closed
            return
        assert used[chosen] <= 50


def test_exact_cases(spark):
    rows = [*ODD, (7, "a b"), (8, "ab"), (9, "a  b"), (10, "a\x0bb "), (11, "a b")]
    got = exact_dedup.find_duplicates(documents(spark, rows)).toPandas()
    assert len(got) == len(rows)
    norm = {d: re.sub(r"[\x20\x09-\x0D]", "", t or "") for d, t in rows}
    for r in got.itertuples():
        d = None if r.doc_id != r.doc_id else int(r.doc_id)
        if d is not None:
            assert r.text_sha256 == hashlib.sha256(norm[d].encode()).hexdigest()
    by = got[got["doc_id"].isin([7, 8, 9, 10])]
    assert set(by["keep_id"]) == {9} and set(by["group_size"]) == {4} and by["kept"].sum() == 1
    assert got.groupby("text_sha256")["kept"].sum().eq(1).all()
    assert set(got[got["doc_id"] == 1]["keep_id"]) == {3}  # the longest of the blank texts
    kept = exact_dedup.drop_duplicates(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == got["text_sha256"].nunique()
    assert exact_dedup.find_duplicates(empty(spark)).count() == 0 == exact_dedup.drop_duplicates(empty(spark)).count()


def test_exact_rounds(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    rows = [(i, f"text {i % 7}") for i in range(200)]
    got = exact_dedup.find_duplicates(documents(spark, rows).repartition(9)).toPandas()
    assert (got["keep_id"] == got["doc_id"] % 7).all() and got["kept"].sum() == 7


@given(st.lists(st.integers(-4, 4), max_size=30))
@settings(max_examples=200, deadline=None)
def test_segments(scores):
    def plain(first, last):
        best = max(((sum(scores[a:b]), a - b, -a) for a in range(first, last) for b in range(a + 1, last + 1)), default=(0,))
        if best[0] <= 0:
            return []
        a = -best[2]
        b = a - best[1]
        # ties: the definition takes the longest of equals that cannot be shortened
        return [*plain(first, a), (a, b - 1, best[0]), *plain(b, last)]

    places = [k for k, s in enumerate(scores) if s > 0]
    got = toxicity.segments(places, [scores[k] for k in places], 0.0) if all(s >= 0 for s in scores) else None
    if got is not None:
        assert sum(p.score for p in got) == sum(scores)
    flat = [s if s > 0 else -1 for s in scores]
    found = toxicity.segments(places, [flat[k] for k in places], 1.0)
    if found:
        best = max(sum(flat[a:b]) for a in range(len(flat)) for b in range(a + 1, len(flat) + 1))
        assert max(p.score for p in found) == pytest.approx(best)
        for p in found:
            assert p.score == pytest.approx(sum(flat[p.first : p.last + 1]))
        assert all(a.last < b.first for a, b in zip(found, found[1:]))


def test_toxicity_cases(spark):
    docs = documents(spark, [*ODD, *((100 + i, f"word{i} " * 5 + ("vile " if i % 2 else "")) for i in range(60))])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(None, 1), (5, None), (4, 1), (4, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(got) == len(ODD) + 60 and got["score"].between(0, 1).all()
    some = got[got["doc_id"] >= 100]
    assert (some["predicted"] == some["doc_id"] % 2).all()
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels.limit(0))).count() == 0
    one = toxicity.score(docs, toxicity.fit(docs, labels.filter("toxic = 0"))).toPandas()
    assert (one["predicted"] == 0).all()


def test_license_cases(spark):
    notice = dict(license_scan.NOTICES)["MIT"]
    rows = [*ODD, (20, f"{LONG} {notice.upper()}! {LONG}"), (21, notice), (22, f"{notice} {notice}"), (23, notice[:60])]
    got = license_scan.scan(documents(spark, rows), [("mit", notice), ("x", "short one"), ("none", "..."), ("null", "")]).toPandas()
    assert sorted(zip(got["doc_id"], got["license_id"])) == [(20, "mit"), (21, "mit"), (22, "mit")]
    assert license_scan.scan(empty(spark)).count() == 0


def _plain_repeats(rows, depth):
    first = {}
    split = [(d if d is not None else 1 << 62, words(t)) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - depth + 1):
            key = tuple(w[i : i + depth])
            first[key] = min(first.get(key, d), d)
    out = []
    for (d, w), (own, _) in zip(split, rows):
        gone = set()
        for i in range(len(w) - depth + 1):
            if first[tuple(w[i : i + depth])] < d:
                gone |= set(range(i, i + depth))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(str, out))


@pytest.mark.parametrize("group", [50, 3_000_000])
def test_repeat_cases(spark, group):
    random.seed(3)
    rows = [*ODD, (30, PASSAGE), (31, f"x {PASSAGE} y z {PASSAGE}"), (32, PASSAGE[:60]), (30, f"{PASSAGE} other")]
    rows += [(40 + i, " ".join(random.choice("ab") for _ in range(60))) for i in range(20)]
    got = substring_dedup.remove_repeats(documents(spark, rows), group_suffixes=group).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept_sha256)) for r in got) == _plain_repeats(rows, 13)
    spans = {r.doc_id: [(s.first, s.last) for s in r.spans] for r in got}
    assert spans[31] == [(1, 40), (43, 82)]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [200, 4_000_000])
def test_jaccard_cases(spark, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    random.seed(5)
    base = [f"b{i}" for i in range(60)]
    rows = [(d, t) for d, t in ODD if d is not None]
    for i in range(40):
        own = list(base)
        for _ in range(random.randint(0, 3)):
            own[random.randrange(len(own))] = f"n{i}{random.random()}"
        rows.append((100 + i, " ".join(own).upper() if i % 5 == 0 else " ".join(own)))
    rows += [(200 + i, " ".join(random.choice("abcd") for _ in range(8))) for i in range(60)]
    rows.sort()
    got = jaccard_join.near_duplicates(documents(spark, rows)).toPandas()
    label = linked_components([t for _, t in rows], 4, 85)
    wanted = sorted((d, len(shingles(t, 4)), rows[label[k]][0]) for k, (d, t) in enumerate(rows))
    assert sorted(zip(got["doc_id"], got["n_shingles"], got["component_id"])) == wanted
    kept = jaccard_join.drop_near_duplicates(documents(spark, rows))
    assert kept.count() == sum(label[k] == k for k in range(len(rows)))
    assert jaccard_join.near_duplicates(empty(spark)).count() == 0
    assert jaccard_join.near_duplicates(documents(spark, ODD)).count() == len(ODD)


@given(st.lists(st.lists(st.integers(0, 6), min_size=4, max_size=4), min_size=1, max_size=120), st.sampled_from([60, 85]))
@settings(max_examples=60, deadline=None)
def test_count_tree(points, percent):
    counts = np.array(points, np.int64)
    sizes = counts.sum(1) + 1
    counts[:, 0] += 1
    possible = [
        (i, j) for i in range(len(sizes)) for j in range(i)
        if (100 + percent) * np.minimum(counts[i], counts[j]).sum() >= percent * (sizes[i] + sizes[j])
        and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])
    ]

    def parts(pairs):
        label = list(range(len(sizes)))
        for _ in label:
            for i, j in pairs:
                label[i] = label[j] = min(label[i], label[j])
        return label

    found = jaccard_join.CountTree(sizes, counts, percent).spanning()
    assert parts(found) == parts(possible) and len(found) == len(sizes) - len(set(parts(possible)))


def test_archive_cases(spark):
    body = "<p>" + "é" * 80
    rows = [
        (5, "http://a.example/x y\r\nz", body), (3, "http://b.example/", body), (9, None, body), (9, None, body), (3, "http://b.example/", body),
        (1, "http://a.example/", None), (2, "http://a.example/", ""), (7, "http://[bad", "x" * 99), (8, "http://c.example", "x" * 99),
        (None, "http://d.example", body), (11, "http://e.example", LONG * 100),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = warc.archive_and_index(pages, shared_dir(spark, "archive")).toPandas()
    assert len(got) == len(rows)
    assert sorted(str(x) for x in got["payload_bytes"]) == sorted(str(len((h or "").encode())) for _, _, h in rows)
    revisits = got[got["record_type"] == "revisit"]
    assert set(revisits["refers_to"]) == {3} and len(revisits) == 4
    assert set(got[got["page_id"] == 3]["record_type"]) == {"response"}
    assert set(got[got["payload_digest"] == hashlib.sha256(body.encode()).hexdigest()]["payload_bytes"]) == {163}
    ordered = got.sort_values("position")
    keys = list(zip(ordered["url_key"], ordered["time"]))
    assert keys == sorted(keys)
    path = shared_dir(spark, "archive")
    assert warc.archive_and_index(pages.limit(0), path).count() == 0


@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
@settings(deadline=None)
def test_loser_tree(runs):
    assert list(warc.LoserTree([sorted(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_large_record():
    payload = random.Random(1).randbytes(17 << 20)
    made = warc.record(1, "u:x", payload, __import__("datetime").datetime(2020, 1, 1), hashlib.sha256(payload).hexdigest(), None)
    records = list(warc.members(memoryview(made + b"\0" + made + b"\0")))
    assert len(records) == 2 and warc.parse(records[1][2])["payload_bytes"] == len(payload)


def test_tiling_cases(spark):
    items = [f"q{k}i{i}" for k in range(1) for i in range(30)]
    item = " ".join(items)
    reordered = " ".join([*items[20:], "gap", *items[10:20], "gap", *items[:10]])
    rows = [
        *ODD, (50, f"{LONG} {item.upper()}"), (51, reordered), (52, " ".join(items[:16])), (53, " ".join(items[:12])),
        (54, " ".join(items[:4] * 10)), (55, " ".join(items[:8] * 20)), (56, "tiny item"), (57, "tiny other item"),
    ]
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "", "x"), (4, "Tiny item!", "x"), (5, "?", "x")], "item_id long, text string, doc_id string")
    for size in (1, 8 << 20):
        got = decontamination.find_matches(documents(spark, rows), bench, block_bytes=size).toPandas()
        assert sorted(zip(got["doc_id"], got["item_id"])) == [(50, 1), (51, 1), (52, 1), (56, 4)]
        clean = decontamination.drop_contaminated(documents(spark, rows), bench, block_bytes=size)
        assert clean.columns == documents(spark, rows).columns and clean.count() == len(rows) - 4
    assert got[got["doc_id"] == 51][["coverage", "n_tiles"]].values.tolist() == [[1.0, 3]]
    assert decontamination.find_matches(empty(spark), bench).count() == 0
    assert decontamination.drop_contaminated(documents(spark, rows), bench.limit(0)).count() == len(rows)


def test_quality_cases(spark):
    docs = documents(spark, [*ODD, *((100 + i, "a fair word of text " * 9 if i % 2 else "%% || " * 30) for i in range(60))])
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(60)] + [(None, 1), (5, None), (4, 1), (4, 0)], "doc_id long, quality int")
    model = quality_ranking.fit(docs, labels)
    got = quality_ranking.score(docs, model).toPandas()
    assert len(got) == len(ODD) + 60 and got["score"].between(0, 1).all()
    some = got[got["doc_id"] >= 100]
    assert (some["predicted"] == some["doc_id"] % 2).all()
    kept = quality_ranking.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == got["predicted"].sum()
    assert quality_ranking.score(empty(spark), quality_ranking.fit(empty(spark), labels.limit(0))).count() == 0


@given(st.lists(st.integers(0, 40), max_size=3000), st.integers(1, 9), st.integers(1, 5))
@settings(max_examples=60, deadline=None)
def test_coding(ids, lanes, steps):
    ids = np.array(ids, np.uint32)
    table = rans.frequencies(np.bincount(ids, minlength=41))
    data = rans.encode_block(ids, [1, None], np.array([len(ids), 0]), 4, 5, table, lanes, steps)
    block, end = rans.read_block(memoryview(data + b"\n"), 0)
    assert end == len(data) and block.doc_ids == [1, None] and (block.ids(table) == ids).all()
    span = lanes * steps
    for k in range(len(block.states)):  # each checkpoint by itself
        assert (block.segment(k, table) == ids[k * span : (k + 1) * span]).all()
    if len(ids):
        with pytest.raises(ValueError):
            rans.read_block(memoryview(data[:-1] + bytes([data[-1] ^ 1])), 0)


def test_token_file_cases(spark):
    path = shared_dir(spark, "tokens")
    token_files.write_tokens(documents(spark, ODD), path, block_ids=1000, part_ids=50_000)
    got = token_files.read_tokens(spark, path, with_ids=True).toPandas().sort_values("start")
    assert [None if d != d else int(d) for d in got["doc_id"]] == [None, None, 1, 2, 3, 4, 4, 5, 6]
    assert got["start"].tolist() == (got["n_tokens"].cumsum() - got["n_tokens"]).tolist()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_tokens for r in got.itertuples())
    path = shared_dir(spark, "tokens")
    token_files.write_tokens(empty(spark), path)
    assert token_files.read_tokens(spark, path).count() == 0
