"""Document quality by Bradley-Terry pairwise ranking.

A document's worth is a linear function of plain statistics of its whole text.
Preference pairs (a good document above a bad one) train it by logistic loss on
the difference of their features.  The cut between kept and rejected is a
quantile of the training scores, the share of bad documents among them; scores
are mapped to 0..1 so that the cut is at ``CUT``.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS`` per
label, chosen by hash of the id), where a row counts for as many training rows
of its label as it stands for; scoring reads every row and the whole text.

Defined cases: a null text is empty; empty texts get a score like any other;
labelled rows with a null id, a null label or differing labels are left out of
training; an id with several texts trains with the one that is lowest by hash; with one label only, every score is that label's side of the cut; an
empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillmere.llm.words import fresh, pieces, split_words
from quillmere.session import written

CUT = 0.3
SAMPLE_ROWS = 20_000  # of each label, for the fit
PAIRS = 200_000
FOLDS = 5  # rows whose id's crc32 is 0 modulo this are held out
_LOWER, _UPPER = range(97, 123), range(65, 91)


def held_out(doc_id: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    """Whether a row is held out: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(texts: pa.Array) -> np.ndarray:
    """Statistics of each text: rows x features."""
    texts = pc.fill_null(texts, "")
    words = split_words(texts)
    n = len(texts)
    count = np.diff(words.starts).astype(float)
    some = np.maximum(count, 1)
    of = words.texts()

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(of, values[words.codes], n) / some

    lengths = np.fromiter(map(len, words.distinct), float, len(words.distinct))
    letters = np.fromiter((sum(map(str.isalpha, w)) for w in words.distinct), float, len(words.distinct))
    upper = np.fromiter((w.isupper() for w in words.distinct), float, len(words.distinct))
    digits = np.fromiter((any(map(str.isdigit, w)) for w in words.distinct), float, len(words.distinct))
    bare = letters == 0
    signs = np.maximum(lengths - letters - 1, 0)  # one sign after a word is usual
    chars = np.maximum(np.bincount(of, lengths[words.codes], n), 1)
    pairs = of * (len(words.distinct) + 1) + words.codes if len(of) else np.empty(0, np.int64)
    different = np.bincount(np.unique(pairs) // (len(words.distinct) + 1), minlength=n) if len(of) else np.zeros(n)
    same = np.zeros(len(of))
    if len(of) > 1:
        same[1:] = (words.codes[1:] == words.codes[:-1]) & (of[1:] == of[:-1])
    lines = pc.count_substring(texts, "\n").to_numpy(zero_copy_only=False) + 1.0
    # a text's own vocabulary: distinct words as against what its length lets one expect
    richness = np.log(np.maximum(different, 1)) / np.log(some + 1)
    return np.column_stack([
        np.log1p(count), per_text(lengths), per_text(letters / np.maximum(lengths, 1)), per_text(upper),
        per_text(digits), per_text(bare.astype(float)), np.bincount(of, signs[words.codes], n) / chars,
        np.bincount(of, same, n) / some, richness, different / some, lines / some, (count == 0).astype(float),
        np.sqrt(per_text(bare.astype(float))), np.sqrt(np.bincount(of, signs[words.codes], n) / chars),
        np.sqrt(np.bincount(of, same, n) / some), np.sqrt(per_text(upper)),
    ])


WIDTH = 16


class Ranking(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0..1; at ``CUT`` where the ranking score is at the cut."""
        worth = np.clip((x - self.centre) / self.scale, -8, 8) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (worth - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def _feature_rows(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "label", "weight")), pa.array(list(x), pa.list_(pa.float64()))],
                names=["doc_id", "label", "weight", "x"],
            )

    return docs.mapInArrow(rows, "doc_id long, label int, weight double, x array<double>")


def labelled(texts: DataFrame, labels: DataFrame, label: str, sample_rows: int, folds: int, fold: int, once: bool) -> DataFrame:
    """doc_id, key (hash of its text), label, weight: of each label the
    ``sample_rows`` usable training rows that are lowest by hash, at most.
    ``weight`` is how many usable rows of that label a chosen one stands for, so
    weighted sums do not depend on whether the bound was reached.  An id has one
    row, with the lowest hash of its texts.  With ``once`` rows are distinct
    texts of a label and not documents."""
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    clean = clean.filter(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), folds, fold)
    )
    clean = clean.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_m"))
    clean = clean.filter(F.col("label") == F.col("_m")).drop("_m")
    one = texts.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("key"))  # however often an id is repeated
    rows = one.join(clean, "doc_id")
    by = "key" if once else "doc_id"
    rows = rows.groupBy(by, "label").agg(F.min("doc_id" if once else "key").alias("doc_id" if once else "key"))
    totals = rows.groupBy("label").agg(F.count(F.lit(1)).alias("_n"))
    mix = F.xxhash64(by)
    sides = [rows.filter(F.col("label") == v).orderBy(mix, by).limit(sample_rows) for v in (0, 1)]
    weight = F.col("_n") / F.least(F.col("_n"), F.lit(sample_rows))
    chosen = sides[0].unionByName(sides[1]).join(F.broadcast(totals), "label")
    return written(chosen.select("doc_id", "key", "label", weight.alias("weight")), "labelled")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Ranking:
    """Ranking from labelled rows that are not held out.  ``sample_rows`` of
    each label at most, the lowest by hash of the id."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labelled(texts, labels, label, sample_rows, FOLDS, 0, once=False)
    sample = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "key"])
    sample = sample.dropDuplicates()  # at most 2 x sample_rows, also if an id is repeated
    rows = _feature_rows(sample).toPandas().sort_values("doc_id")
    x = np.array(rows["x"].tolist(), float).reshape(-1, WIDTH)
    return learn(x, rows["label"].to_numpy(int), rows["weight"].to_numpy(float))


def learn(x: np.ndarray, y: np.ndarray, weight: np.ndarray, pairs: int = PAIRS, rounds: int = 300) -> Ranking:
    """Ranking from features and labels; a row counts ``weight`` times."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        side = 1.0 if len(good) or not len(bad) else -1.0
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), -side, 2.0)
    centre = np.average(x, 0, weight)
    scale = np.sqrt(np.average((x - centre) ** 2, 0, weight)) + 1e-6
    z = np.clip((x - centre) / scale, -8, 8)
    deal = np.random.default_rng(7)
    n = min(pairs, 20 * len(y))
    apart = z[deal.choice(good, n)] - z[deal.choice(bad, n)]  # preferred minus other
    weights, moment, speed = np.zeros(WIDTH), np.zeros(WIDTH), np.zeros(WIDTH)
    for step in range(1, rounds + 1):  # logistic loss, a little shrinkage, steps by moments
        pull = 1 / (1 + np.exp(np.clip(apart @ weights, -30, 30)))
        slope = -(apart * pull[:, None]).mean(0) + 1e-3 * weights
        moment, speed = 0.9 * moment + 0.1 * slope, 0.99 * speed + 0.01 * slope**2
        weights -= 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.99**step)) + 1e-8)
    worth = z @ weights
    cut = _quantile_cut(worth, y, weight)
    spread = abs(np.median(worth[good]) - np.median(worth[bad])) + 1e-6
    return Ranking(centre, scale, weights, cut, 6 / spread)


def _quantile_cut(worth: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The score at the share of bad documents, in the middle of the widest
    gap near that quantile, so that it lies between the two kinds."""
    bad = weight[y == 0].sum()
    order = np.argsort(worth, kind="stable")
    ordered, below = worth[order], np.cumsum(weight[order]) - weight[order]
    near = [max(0, int(np.searchsorted(below, bad * f, "right")) - 1) for f in (0.8, 1.2)]
    low, high = near[0], max(near[1], near[0] + 1)
    part = ordered[low : high + 1]
    if len(part) < 2:
        return float(part[0])
    k = int(np.argmax(np.diff(part)))
    return float((part[k] + part[k + 1]) / 2)


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            s = model.scores(features(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.mapInArrow(scored, "doc_id long, score double, predicted int")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``CUT``, all columns."""
    names = docs.columns
    (own,) = fresh(docs, "text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own):
            yield batch.filter(pa.array(model.scores(features(batch.column(own))) >= CUT))

    body = docs.withColumn(own, F.col("text").cast("string"))
    return body.mapInArrow(kept, body.schema).select(*[F.col(f"`{c}`") for c in names])
