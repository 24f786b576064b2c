"""Benchmark passages in documents, by greedy string tiling.

Terms (lower-cased words without signs at their ends) are hashed, and runs of
``SHORTEST`` terms by a rolling hash.  Shared runs are the seeds that join
documents and items.  Each such pair is tiled: the longest match of terms not
yet marked, found by rolling hashes of its length, is marked, again and again,
down to ``SHORTEST``.  Pairs of places are never listed.  The share of an
item's terms under tiles is its coverage, which does not depend on the order of
its parts, so reordered passages count in full.

The benchmark is the query set: it is taken in blocks of ``BLOCK_BYTES``, each
sent to the tasks and held against all documents in one scan without a shuffle.

Defined cases: null and empty texts and items match nothing; an item of fewer
than ``SHORTEST`` terms matches only as a whole; rows with equal ids are
documents of their own; empty tables give no matches; other columns pass
through ``drop_contaminated`` unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmere.llm.toxicity import term
from quillmere.llm.words import fresh, hashes, pieces, split_words, windows
from quillmere.session import written

SHORTEST = 5  # terms of the shortest tile
COVERAGE = 0.5  # of an item's terms, from which on a document holds it
BLOCK_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms in a row, and where each text's terms begin."""
    words = split_words(texts)
    terms = [term(w) for w in words.distinct]
    hashed = hashes(terms)
    real = np.fromiter((t != "" for t in terms), bool, len(terms))
    there = real[words.codes] if len(words.codes) else np.empty(0, bool)
    starts = np.concatenate(([0], np.cumsum(there)))[words.starts]
    return hashed[words.codes[there]] if len(words.codes) else np.empty(0, np.uint64), starts


class _Rolling:
    """Polynomial hashes of runs of any length, from sums up to each place."""

    def __init__(self, row: np.ndarray):
        with np.errstate(over="ignore"):
            ones = np.ones(len(row) + 1, np.uint64)
            up, down = ones.copy(), ones.copy()
            up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.shift = np.cumprod(down)
            self.sums = np.concatenate((ones[:1] - ones[:1], np.cumsum(row * np.cumprod(up)[:-1], dtype=np.uint64)))

    def runs(self, at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.shift[at]


def tiles(item: np.ndarray, text: np.ndarray, free: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Tiles (place in the item, place in the text, length) of two rows of
    terms, of which ``free`` says what of the text may be marked.  The longest
    unmarked match is marked first, ties by the lowest places.

    Lengths only fall.  The next one is found by bisection: where a run of a
    length agrees, so does one of each shorter length.  All tiles of one length
    are marked in one pass, in which the places of a run in the text are gone
    through once.  Memory is linear in the two rows, and there are fewer lengths
    than the root of twice the item's terms, whatever repeats in them."""
    room = np.ones(len(item), bool), free.copy()
    rolling = [_Rolling(row) for row in (item, text)]
    made: list[tuple[int, int, int]] = []

    def runs(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(places, rolling hashes) of the unmarked runs of ``n`` terms of both rows."""
        found = []
        for row, left in zip(rolling, room):
            marked = np.concatenate(([0], np.cumsum(~left)))
            at = np.flatnonzero(marked[n:] == marked[:-n])
            found.append((at, row.runs(at, n)))
        return found

    def agree(n: int) -> bool:
        (_, a), (_, b) = runs(n)
        return bool(np.isin(a, b).any())

    high = min(len(item), len(text))
    while high >= size and agree(size):
        low = size
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if agree(middle) else (low, middle - 1)
        (i, a), (j, b) = runs(low)
        by = np.argsort(b, kind="stable")
        j, b = j[by], b[by]
        begins, ends = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        met, last = {}, 0  # how far the places of a run are gone through; where the last tile in the item ends
        for k in np.flatnonzero(begins < ends).tolist():
            place, at, end = int(i[k]), met.get(int(begins[k]), int(begins[k])), int(ends[k])
            if place < last:
                continue
            while at < end and not (room[1][j[at]] and room[1][j[at] + low - 1]):
                at += 1
            if at < end and (item[place : place + low] == text[j[at] : j[at] + low]).all():
                made.append((place, int(j[at]), low))
                last = place + low
                room[0][place:last] = False
                room[1][j[at] : j[at] + low] = False
            met[int(begins[k])] = at
        high = low - 1
    return made


def _under(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``n`` places lie under the runs of ``size`` that begin at ``at``."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.subtract.at(change, at + size, 1)
    return np.cumsum(change[:-1]) > 0


class Benchmark:
    """A block of items, as hashes."""

    def __init__(self, ids: list[int], texts: list[str]):
        hashed, starts = _terms(pa.array(texts, pa.string()))
        self.ids = ids
        self.items = [hashed[a:b] for a, b in zip(starts, starts[1:])]
        self.sizes = sorted({min(SHORTEST, len(x)) for x in self.items if len(x)})
        self.seeds = {}
        for size in self.sizes:  # distinct runs, where each one's items begin, and the items and places of all
            own = [k for k, x in enumerate(self.items) if min(SHORTEST, len(x)) == size]
            rolled = [windows(self.items[k], size, _BASE) for k in own]
            item = np.repeat(np.array(own), [len(r) for r in rolled])
            place = np.concatenate([np.arange(len(r)) for r in rolled])
            run = np.concatenate(rolled)
            by = np.lexsort((place, item, run))
            runs, first = np.unique(run[by], return_index=True)
            self.seeds[size] = runs, np.concatenate((first, [len(by)])), item[by], place[by]

    def covered(self, text: np.ndarray, at: np.ndarray, seed: np.ndarray, size: int, least: float):
        """(item, coverage, tiles) of the items seeded at the places ``at`` of
        the text by the runs numbered ``seed`` whose coverage is ``least`` or
        more.  Each item's places come from the distinct runs, however often
        these are in the text; an item whose terms under them are too few is
        left, as tiles cover no others."""
        _, begins, items, places = self.seeds[size]
        met = np.unique(seed)
        count = begins[met + 1] - begins[met]
        entry = np.repeat(begins[met] - np.cumsum(count) + count, count) + np.arange(count.sum())
        run = np.repeat(met, count)
        by = np.argsort(items[entry], kind="stable")
        entry, run = entry[by], run[by]
        item = items[entry]
        for some in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            k = int(item[some[0]])
            n = len(self.items[k])
            under = _under(places[entry[some]], n, size)
            if np.count_nonzero(under) < least * n:
                continue
            # the stretches of the text that the item's runs cover, with a barrier between
            free = np.flatnonzero(_under(at[np.isin(seed, run[some])], len(text), size))
            gap = np.concatenate(([False], np.diff(free) > 1))
            to = np.arange(len(free)) + np.cumsum(gap)
            part, room = np.zeros(to[-1] + 1, np.uint64), np.zeros(to[-1] + 1, bool)
            part[to], room[to] = text[free], True
            made = tiles(self.items[k], part, room, size)
            share = sum(length for _, _, length in made) / n
            if share >= least:
                yield k, share, len(made)

    def matches(self, texts: pa.Array, coverage: float) -> list[tuple[int, int, float, int]]:
        """(row, item id, coverage, tiles) of each document that holds an item."""
        hashed, starts = _terms(texts)
        found = []
        for size in self.sizes:
            seeds = self.seeds[size][0]
            rolled = windows(hashed, size, _BASE)
            if not len(rolled):
                continue
            coarse = np.zeros(1 << 18, bool)  # most runs are told apart by a few bits
            coarse[seeds >> np.uint64(46)] = True
            at = np.flatnonzero(coarse[rolled >> np.uint64(46)])
            at = at[seeds[np.minimum(np.searchsorted(seeds, rolled[at]), len(seeds) - 1)] == rolled[at]]
            row = np.searchsorted(starts, at, "right") - 1
            inside = at + size <= starts[row + 1]
            at, row = at[inside], row[inside]
            number = np.searchsorted(seeds, rolled[at])
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(row)) + 1) if len(at) else ():
                r = int(row[some[0]])
                text = hashed[starts[r] : starts[r + 1]]
                for k, share, n in self.covered(text, at[some] - starts[r], number[some], size, coverage):
                    found.append((r, self.ids[k], share, n))
        return found


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The items, ``block_bytes`` of text at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    ids, texts, size = [], [], 0
    for row in rows.filter(F.col("text").isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if size >= block_bytes:
            yield Benchmark(ids, texts)
            ids, texts, size = [], [], 0
    yield Benchmark(ids, texts)


def _matched(docs: DataFrame, block: Benchmark, coverage: float) -> DataFrame:
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = block.matches(batch.column("text"), coverage)
            row, item, share, n = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(item, pa.int64()),
                pa.array(share, pa.float64()), pa.array(n, pa.int64()),
            ], names=["doc_id", "item_id", "coverage", "n_tiles"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(found, "doc_id long, item_id long, coverage double, n_tiles long")


def find_matches(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles for each document and item whose
    coverage is at least ``coverage``."""
    out: list[DataFrame] = []
    for block in blocks(benchmark, block_bytes):
        found = _matched(docs, block, coverage)
        out.append(found if not out and len(block.ids) < 2 else written(found, "benchmark-matches"))
    return reduce(DataFrame.unionByName, out)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns."""
    names = docs.columns
    (own,) = fresh(docs, "text")
    kept = docs.withColumn(own, F.col("text").cast("string"))

    def keeper(block: Benchmark):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, own):
                stays = np.ones(batch.num_rows, bool)
                stays[[r for r, *_ in block.matches(batch.column(own), coverage)]] = False
                yield batch.filter(pa.array(stays))

        return clean

    for k, block in enumerate(blocks(benchmark, block_bytes)):
        kept = (written(kept, "benchmark-clean") if k else kept).mapInArrow(keeper(block), kept.schema)
    return kept.select(*[F.col(f"`{c}`") for c in names])
