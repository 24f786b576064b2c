"""Runs of words against trying every period, and the defined cases."""

import random

import numpy as np
import pytest
from helpers import documents, words
from hypothesis import given, settings, strategies as st

from quillmere.llm import periodic_runs


def plain_runs(x):
    """(start, length, period) by comparing the words at every distance."""
    n, some = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q):
                some.append((s, i + q, q))
            i += i == s
    smallest = [(s, e - s, q) for s, e, q in some if not any(p < q and b <= s and f >= e for b, f, p in some)]
    return sorted(smallest, key=lambda r: (r[0], r[2]))


def collapsed(x, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


@given(
    st.lists(st.integers(0, 3), min_size=1, max_size=80), st.integers(0, 79), st.integers(1, 30), st.integers(0, 150),
    st.lists(st.integers(0, 3), max_size=20),
)
@settings(max_examples=400, deadline=None)
def test_runs(before, a, period, length, after):
    x = before[: a + 1]
    x += [x[-1 - k % period % len(x)] for k in range(length)] + after
    assert periodic_runs.runs_of(x) == plain_runs(x)
    twice = x + x
    assert periodic_runs.runs_of(twice) == plain_runs(twice)


def test_segments_are_last_ends():
    """Each segment gives the last end before of the longest of its words."""
    rng = random.Random(3)
    x = [rng.randrange(2) for _ in range(120)]
    automaton = periodic_runs.LinkCutAutomaton()
    for i, word in enumerate(x):
        found, bound = automaton.append(word), i + 2
        for end, length in found:
            suffix = x[i + 1 - length : i + 1]
            ends = [j for j in range(length - 1, i) if x[j + 1 - length : j + 1] == suffix]
            assert length < bound and ends[-1] == end
            bound = length


@pytest.mark.parametrize("make", [
    lambda n: [0] * n, lambda n: [i % 97 for i in range(n)], lambda n: [i * i % 1009 % 7 for i in range(n)],
])
def test_work_grows_as_n_log_n(make, monkeypatch):
    steps, rotate = [0], periodic_runs.LinkCutAutomaton._rotate

    def counted(self, x):
        steps[0] += 1
        rotate(self, x)

    monkeypatch.setattr(periodic_runs.LinkCutAutomaton, "_rotate", counted)
    done = []
    for n in (4_000, 8_000):
        steps[0] = 0
        periodic_runs.runs_of(make(n))
        done.append(steps[0])
    assert done[1] <= 2.4 * done[0] + 100


def _check(got, rows):
    for d, t in rows:
        x = words(t)
        runs = plain_runs(x) if len(x) < 3000 else None
        mine = [r for r in got if r["doc_id"] == d and r["n_words"] == len(x)]
        assert mine
        if runs is not None:
            assert any(
                [tuple(r) for r in m["runs"]] == runs and m["collapsed"] == collapsed(x, runs) for m in mine)


def test_cases(spark):
    line = "the same twelve words of one line come again and again here "
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (None, None), (5, "a " * 24), (6, "a " * 23),
        (7, line * 4), (8, "x y " * 3 + line * 3 + "tail"), (9, "é\xa0b " * 30), (10, (line + "odd ") * 3 + line), (11, "A a " * 12),
        (12, line * 2), (13, "b\x0b" * 40), (14, " ".join(f"w{i % 1500}" for i in range(2990))),
        (15, " ".join(f"w{i % 20_000}" for i in range(70_000))), (16, " ".join(f"w{i}" for i in range(50_000))),
    ]
    got = periodic_runs.find_runs(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    _check(got, rows)
    by = {r["doc_id"]: r for r in got}
    assert [tuple(r) for r in by[15]["runs"]] == [(0, 70_000, 20_000)] and not by[16]["runs"]
    assert by[15]["collapsed"].split() == [f"w{i}" for i in range(20_000)]
    assert periodic_runs.find_runs(documents(spark, []).limit(0)).count() == 0


def test_stretches_end_with_their_text(spark):
    """A run does not go on into the next document of a batch."""
    rows = [(k, "a " * 12) for k in range(50)] + [(100, "a " * 30), (101, "a " * 30)]
    got = periodic_runs.find_runs(documents(spark, rows).coalesce(1)).collect()
    assert {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in got} == {
        **{k: [] for k in range(50)}, 100: [(0, 30, 1)], 101: [(0, 30, 1)]}


def test_planted_periods(spark):
    import zlib

    rows = [(k, " ".join(f"w{i}" for i in range(k % 90))) for k in range(400)] + [(None, "a b"), (3, None)]
    got = periodic_runs.with_planted_periods(documents(spark, rows)).collect()
    wanted = []
    for d, t in rows:
        x = words(t)
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and x:
            a, g = h // 10 % len(x), h // 10
            p = 1 + (len(x) - a) // (3 + g % 8)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(len(x))]
        wanted.append((str(d), " ".join(x)))
    assert sorted((str(r[0]), " ".join(words(r[1]))) for r in got) == sorted(wanted)


def test_strongest(spark):
    from pyspark.sql import functions as F

    runs = [[(0, 24, 8), (30, 48, 16), (90, 25, 8), (200, 25, 8)], [], [(5, 70, 7), (5, 80, 8)]]
    frame = spark.createDataFrame([(r,) for r in runs], "runs array<struct<start:long,length:long,period:long>>")
    best = [r[0] and tuple(r[0]) for r in frame.select(periodic_runs.strongest(F.col("runs"))).collect()]
    assert best == [(90, 25, 8), None, (5, 70, 7)]


def test_hashes_only_nominate(spark, monkeypatch):
    """Where all windows hash alike, everything goes through the automaton and the rows stay."""
    monkeypatch.setattr(periodic_runs, "windows", lambda values, size, base: np.zeros(max(0, len(values) - size + 1), np.uint64))
    starts = np.array([0, 40, 340])
    codes = np.array([i % 2 for i in range(40)] + [*range(2, 302)])
    bounds = list(zip(*periodic_runs._stretches(codes, starts, 24, 8)))
    assert bounds == [(0, 40), (40, 340)]
    assert [periodic_runs.runs_of(codes[b:e].tolist()) for b, e in bounds] == [[(0, 40, 2)], []]
