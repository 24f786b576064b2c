"""Periodic runs of words, by a suffix automaton with link-cut access.

The words of a stretch are appended one by one to a suffix automaton.  Its
suffix links are a link-cut tree in which every preferred path has one colour:
the place where its words ended last.  Appending a word makes the path from the
new state to the root the preferred one (``access``); each segment that it
takes over tells the previous end of its longest word.  If the distance to the
new end is no more than the word's length, the word and its copy make a square
of that period, and where the word is twice as long as the distance, a cube:
its stretch is then extended both ways to a run.  The word is the longest whose
last end is the previous one, so the distance is the smallest period.

A run of at least ``3 * period`` and 24 words repeats every window of 8 of its
words one period before or behind, within itself.  So only unbroken rows of
windows that occur twice in their document, found by hashes for a whole batch,
go through the automaton; equal hashes of unequal windows cost time, not rows.

Defined cases: a null or blank text has no words, no runs and an empty
collapsed text; rows with equal or null ids are documents of their own; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, other
columns are ignored.  A document is one row, so it is searched in one task; no
row waits for another and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillmere.llm.words import mixed, pieces, windows

LEAST = 24  # words of a run
TIMES = 3  # periods of a run
WINDOW = 8  # words; every window of a run occurs a period away: 2 * period + WINDOW <= max(LEAST, TIMES * period)
BASE = 0x9E3779B97F4A7C15 | 1
SPACES = "[ \\t-\\r]+"


class LinkCutAutomaton:
    """Suffix automaton of the words so far; ``append`` gives the segments of
    the new state's path to the root as (previous end, longest length)."""

    def __init__(self):
        self.length, self.link, self.step = [0], [-1], [{}]
        self.last = 0
        # splay trees of preferred paths, by depth; up is the path's parent at a tree's root
        self.up, self.left, self.right, self.end = [-1], [-1], [-1], [-1]
        self.n = 0

    def _state(self, length: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(-1)
        self.step.append(step)
        self.up.append(-1)
        self.left.append(-1)
        self.right.append(-1)
        self.end.append(-1)
        return len(self.length) - 1

    def append(self, word: int) -> list[tuple[int, int]]:
        length, link, step = self.length, self.link, self.step
        new, p = self._state(length[self.last] + 1, {}), self.last
        while p >= 0 and word not in step[p]:
            step[p][word] = new
            p = link[p]
        if p < 0:
            link[new] = 0
        else:
            q = step[p][word]
            if length[q] != length[p] + 1:
                copy = self._state(length[p] + 1, dict(step[q]))
                link[copy] = link[q]
                link[q] = copy
                self._put_above(copy, q)
                while p >= 0 and step[p].get(word) == q:
                    step[p][word] = copy
                    p = link[p]
                q = copy
            link[new] = q
        self.up[new] = link[new]
        self.last = new
        found = self._access(new)
        self.n += 1
        return found

    def _put_above(self, copy: int, q: int) -> None:
        """``copy`` between ``q`` and its parent, on the path of ``q``."""
        self._splay(q)
        before = self.left[q]
        self.left[copy] = before
        if before >= 0:
            self.up[before] = copy
        self.left[q] = copy
        self.up[copy] = q

    def _access(self, new: int) -> list[tuple[int, int]]:
        up, right, end = self.up, self.right, self.end
        found, below, u = [], new, up[new]
        while u >= 0:
            self._splay(u)
            if u:
                found.append((end[u], self.length[u]))
            cut = right[u]
            if cut >= 0:
                end[cut] = end[u]  # the deeper part keeps its colour on a path of its own
            right[u] = below
            below, u = u, up[u]
        self._splay(new)
        end[new] = self.n
        return found

    def _splay(self, x: int) -> None:
        """``x`` to the root of its tree; the path's colour goes with the root."""
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if y < 0 or (left[y] != x and right[y] != x):
                return
            z = up[y]
            y_root = z < 0 or (left[z] != y and right[z] != y)
            if not y_root:
                w = up[z]
                z_root = w < 0 or (left[w] != z and right[w] != z)
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
                self._rotate(x)
                if z_root:
                    self.end[x] = self.end[z]
            else:
                self._rotate(x)
                self.end[x] = self.end[y]

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        if left[y] == x:
            b = right[x]
            left[y] = b
            right[x] = y
        else:
            b = left[x]
            right[y] = b
            left[x] = y
        if b >= 0:
            up[b] = y
        up[y] = x
        up[x] = z


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of ``words``, by start, then period."""
    automaton, found, reached, n = LinkCutAutomaton(), [], {}, len(words)
    for i, word in enumerate(words):
        for end, length in automaton.append(word):
            period = i - end
            if length < (times - 1) * period or length + period < least or reached.get(period, -1) >= i:
                continue
            start, stop = i - length - period + 1, i + 1
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while stop < n and words[stop] == words[stop - period]:
                stop += 1
            reached[period] = stop - 1
            found.append((start, stop - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _stretches(codes: np.ndarray, starts: np.ndarray, least: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of unbroken rows of windows that occur twice in their document."""
    places = windows(mixed(codes.astype(np.uint64) + np.uint64(1)), window, BASE)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if not len(places):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = text[: len(places)] == text[window - 1 :]
    marks = mixed(places ^ mixed(text[: len(places)].astype(np.uint64), 1), 2)
    order = np.flatnonzero(inside)[np.argsort(marks[inside])]
    same = marks[order][1:] == marks[order][:-1]
    twice = np.zeros(len(places) + 2, bool)
    twice[order[1:][same] + 1] = True
    twice[order[:-1][same] + 1] = True
    edge = np.diff(twice.astype(np.int8))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # rows of windows that meet where a text ends are rows of two texts; texts keep apart as no window lies across
    bounds = first, last + window - 1
    enough = bounds[1] - bounds[0] >= least
    return bounds[0][enough], bounds[1][enough]


def find_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then
    period) and collapsed: the words that are in no run behind its first
    period, joined by one space.  ``least`` and ``times`` are at least 24 and 3."""
    if least < LEAST or times < TIMES:
        raise ValueError(f"runs have at least {LEAST} words and {TIMES} periods")
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            lists = pc.ascii_split_whitespace(pc.fill_null(batch.column("text"), ""))
            flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(there)))[offsets - offsets[0]]
            flat = flat.filter(pa.array(there))
            codes = flat.dictionary_encode().indices.to_numpy()
            kept, found = np.ones(len(flat), bool), [[] for _ in range(batch.num_rows)]
            for begin, end in zip(*_stretches(codes, starts, least, WINDOW)):
                text = int(np.searchsorted(starts, begin, "right")) - 1
                for start, length, period in runs_of(codes[begin:end].tolist(), least, times):
                    at = int(begin) + start
                    kept[at + period : at + length] = False
                    found[text].append({"start": at - int(starts[text]), "length": length, "period": period})
            left = np.concatenate(([0], np.cumsum(kept)))[starts].astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(kept)))
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(np.diff(starts), pa.int64()),
                "runs": pa.array(found, pa.list_(run)), "collapsed": pc.binary_join(words, " "),
            })

    return rows.mapInArrow(
        search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def strongest(runs: Column) -> Column:
    """The run with the greatest length over period, the first of equals."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda a, b: F.when(a.isNull() | more(a, b), b).otherwise(a))


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, a known tenth of the documents made periodic: let h be
    crc32 of the id and g a tenth of it; where ten divides h, each word from
    a = g % n on becomes a word of the first p behind a.  Documents without an
    id stay as they are."""
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size("words")
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    a = F.col("g") % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))
    bounds = chosen.select("doc_id", "text", "words", n.alias("n"), F.when(n > 0, a).alias("a"), F.when(n > 0, p).alias("p"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    turned = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.get("words", place(i).cast("int"))
    )
    return bounds.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))
