"""Greedy string tiling against its definition, also where words repeat."""

import random
import time

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from quillmere.llm import decontamination


def plain_tiles(item, text, free, size):
    """The longest match of unmarked terms, then the lowest places, again and again."""
    marked_item, marked_text, made = set(), {j for j, f in enumerate(free) if not f}, []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while (i + n < len(item) and j + n < len(text) and item[i + n] == text[j + n]
                       and i + n not in marked_item and j + n not in marked_text):
                    n += 1
                if n >= size and (best is None or n > best[2]):
                    best = i, j, n
        if best is None:
            return made
        i, j, n = best
        made.append(best)
        marked_item |= set(range(i, i + n))
        marked_text |= set(range(j, j + n))


@given(
    st.lists(st.integers(1, 3), min_size=1, max_size=30), st.lists(st.integers(1, 3), min_size=1, max_size=40),
    st.lists(st.booleans(), min_size=40, max_size=40), st.integers(1, 5),
)
@settings(max_examples=150, deadline=None)
def test_tiles(item, text, barred, size):
    free = [not b or k % 3 > 0 for k, b in zip(range(len(text)), barred)]
    got = decontamination.tiles(np.array(item, np.uint64), np.array(text, np.uint64), np.array(free), size)
    assert got == plain_tiles(item, text, free, size)


def test_matches_of_repeated_words():
    deal = random.Random(4)
    for _ in range(60):
        items = [" ".join(deal.choice("abc") for _ in range(deal.randint(1, 25))) for _ in range(4)]
        texts = [" ".join(deal.choice("abcd") for _ in range(deal.randint(0, 60))) for _ in range(5)]
        block = decontamination.Benchmark([10, 11, 12, 13], items)
        wanted = []
        for r, text in enumerate(texts):
            for k, item in enumerate(items):
                a, b = item.split(), text.split()
                made = plain_tiles(a, b, [True] * len(b), min(decontamination.SHORTEST, len(a)))
                share = sum(n for *_, n in made) / len(a)
                if share >= 0.5:
                    wanted.append((r, 10 + k, share, len(made)))
        assert sorted(block.matches(pa.array(texts), 0.5)) == sorted(wanted)


def test_one_word_again_and_again():
    """5,000 by 20,000 equal words, which are 10^8 pairs of places."""
    block = decontamination.Benchmark([1], ["no " * 5_000])
    began = time.perf_counter()
    assert block.matches(pa.array(["no " * 20_000]), 0.5) == [(0, 1, 1.0, 1)]
    assert time.perf_counter() - began < 3
