"""Work that grows with the input, counted in executed lines; skewed ids."""

import random
import sys

import numpy as np
import pytest
from helpers import documents

from quillmere.llm import packing, toxicity


def lines(function, *arguments):
    """How many lines of ``function`` itself are run."""
    count = 0

    def local(frame, event, arg):
        nonlocal count
        count += event == "line"
        return local

    sys.settrace(lambda frame, event, arg: local if frame.f_code is function.__code__ else None)
    try:
        function(*arguments)
    finally:
        sys.settrace(None)
    return count


def _falling(n):
    return [3 * k for k in range(n)], [1.0] * n, 1.0  # the total falls at each hit


def _rising(n):
    return list(range(n)), [1.0 + k % 3 for k in range(n)], 0.1


def _stairs(n):
    rng = random.Random(n)
    return sorted(rng.sample(range(5 * n), n)), [rng.choice([0.2, 1.0, 4.0]) for _ in range(n)], 0.35


@pytest.mark.parametrize("make", [_falling, _rising, _stairs])
def test_segments_are_found_in_linear_time(make):
    few, many = (lines(toxicity.segments, *make(n)) for n in (2_000, 4_000))
    assert many <= 2.2 * few


def _plain_segments(scores):
    """Maximal scoring segments by definition: the best one, then left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9 or abs(total - best[2]) <= 1e-9 and (j - i) < best[1] - best[0]):
                best = i, j, total
    if best is None:
        return []
    i, j, total = best
    left, right = _plain_segments(scores[:i]), _plain_segments(scores[j + 1 :])
    return [*left, best, *((a + j + 1, b + j + 1, t) for a, b, t in right)]


def test_segments_against_the_definition():
    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 25)
        gains = {k: rng.choice([0.37, 1.13, 2.71, 3.01]) + rng.random() / 100 for k in range(n) if rng.random() < 0.5}
        found = toxicity.segments(list(gains), list(gains.values()), 0.83)
        wanted = _plain_segments([gains.get(k, -0.83) for k in range(n)])
        assert [(p.first, p.last) for p in found] == [w[:2] for w in wanted]
        assert [p.score for p in found] == pytest.approx([w[2] for w in wanted])


def test_one_id_for_all_rows_is_dealt_out(spark):
    rows = [(7 if k % 10 else None, f"some words {k} " * (1 + k % 40)) for k in range(600)]
    placed = packing.pack_documents(documents(spark, rows), capacity=64, open_bins=8, task_tokens=2_000)
    got = placed.toPandas()
    tasks = np.bincount(got["sequence_id"].to_numpy(np.int64) >> 40)
    assert len(tasks) > 5 and tasks.max() <= 2 * tasks.mean()
    ordered = got.sort_values(["sequence_id", "offset"])
    ends = ordered.groupby("sequence_id")["length"].cumsum()
    assert (ends - ordered["length"] == ordered["offset"]).all() and ends.max() <= 64
