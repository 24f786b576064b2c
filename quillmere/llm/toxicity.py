"""Toxic passages by maximum-scoring segments over word log-odds.

1. Terms (lower-cased words without signs at their ends) of a bounded sample of
   labelled rows give document counts per label; those that lean to the toxic
   side are candidates, ``LEXICON`` at most.
2. One pass over all documents counts the candidates: the corpus shares are the
   Dirichlet prior of the final log-odds; terms whose log-odds stand out by
   ``Z`` standard errors get them as score.
3. A linear scan of each whole text finds every maximal scoring segment (each
   word costs ``DRIFT``, so a segment ends where too little follows).
4. A segment's score becomes an extreme-value p-value for a text of that
   length; the evidence of the significant segments of a text is summed, and a
   logistic curve fitted on the sample turns it into the score.  There a row
   counts for as many training rows of its label as it stands for, so the curve
   has their ratio and not that of the bounded sample.

Defined cases: a null text is empty; a text without evidence gets the weighted
share of toxic rows among such texts of the sample; labelled rows with a null id, or with
differing labels, are left out; an id with several texts trains with one; with one label only every row scores its rate;
an empty table gives an empty result.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmere.llm.quality_ranking import held_out, labelled
from quillmere.llm.words import Words, pieces, split_words

SAMPLE_ROWS = 20_000  # of each label, for the fit
LEXICON = 65_536  # candidate terms at most
PRIOR = 20.0  # weight of the prior, in documents' worth of terms
LEAST = 0.5  # and at least this for each term
Z = 3.0
DRIFT = 0.15
SIGNIFICANT = 0.05
CUT = 0.3
FOLDS, FOLD = 4, 2


def term(word: str) -> str:
    """Lower case, without signs at either end."""
    if word.isalnum():
        return word.lower()
    first, last = 0, len(word)
    while first < last and not word[first].isalnum():
        first += 1
    while last > first and not word[last - 1].isalnum():
        last -= 1
    return word[first:last].lower()


class Passage(NamedTuple):
    first: int  # word
    last: int
    score: float


def segments(places: list[int], gains: list[float], drift: float) -> list[Passage]:
    """All maximal scoring segments of a text whose words at ``places`` gain
    and whose other words cost ``drift``, in linear time: open candidates are
    kept with the running total before and after them and the last candidate
    before that begins lower.  A new one follows these links and swallows what
    it improves on; where nothing begins lower, all open ones are final."""
    done: list[Passage] = []
    open_: list[tuple[float, float, int, int, int]] = []  # total before, total after, first, last, link
    total, at = 0.0, -1
    for place, gain in zip(places, gains):
        total -= drift * (place - at - 1)
        before, first = total, place
        total += gain
        at = place
        k = len(open_) - 1
        while k >= 0 and open_[k][0] >= before:
            k = open_[k][4]
        while k >= 0 and open_[k][1] < total:
            before, _, first, _, link = open_[k]
            del open_[k:]
            k = link
        if k < 0:
            done += [Passage(f, l, after - left) for left, after, f, l, _ in open_]
            open_ = []
        open_.append((before, total, first, place, k))
    return done + [Passage(f, l, after - left) for left, after, f, l, _ in open_]


class Toxicity(NamedTuple):
    gains: dict[str, float]  # score of a term, without the drift
    rate: float  # share of words of the corpus that gain
    decay: float  # of the extreme-value tail
    base: float  # logistic curve over the evidence
    slope: float

    def passages(self, words: Words) -> list[list[Passage]]:
        """Of each text."""
        of_word = np.array([self.gains.get(term(w), 0.0) for w in words.distinct] or [0.0])
        here = of_word[words.codes] if len(words.codes) else np.empty(0)
        hits = np.flatnonzero(here > 0)
        text = np.searchsorted(words.starts, hits, "right") - 1
        out: list[list[Passage]] = [[] for _ in range(len(words.starts) - 1)]
        bounds = np.flatnonzero(np.diff(text)) + 1
        for some in np.split(hits, bounds) if len(hits) else ():
            k = int(np.searchsorted(words.starts, some[0], "right")) - 1
            gains = (here[some] - DRIFT).tolist()
            out[k] = segments((some - words.starts[k]).tolist(), gains, DRIFT)
        return out

    def excess(self, passage: Passage, length: int) -> float:
        """Normalised score: its p-value is 1 - exp(-exp(-excess))."""
        return self.decay * passage.score - np.log(max(self.rate * length, 1e-9))

    def significant(self, passage: Passage, length: int) -> bool:
        return 1 - np.exp(-np.exp(-min(self.excess(passage, length), 50.0))) <= SIGNIFICANT

    def evidence(self, words: Words, passages: list[list[Passage]] | None = None) -> np.ndarray:
        lengths = np.diff(words.starts).tolist()
        return np.array([
            np.log1p(sum(max(0.0, self.excess(p, n)) for p in found if self.significant(p, n)))
            for found, n in zip(self.passages(words) if passages is None else passages, lengths)
        ] or [0.0])[: len(lengths)]

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * evidence, -30, 30)))


def _label_counts(sample: DataFrame) -> DataFrame:
    """term, documents of each label that hold it; the row with a null term
    counts documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = split_words(batch.column("text"))
            terms, of_word = np.unique(np.array([term(w) for w in words.distinct] or [""], object), return_inverse=True)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            n = len(terms)
            seen = np.unique(words.texts() * n + of_word[words.codes]) if len(words.codes) else np.empty(0, np.int64)
            toxic = np.bincount(seen % n, label[seen // n], n).astype(np.int64)
            both = np.bincount(seen % n, minlength=n)
            yield pa.RecordBatch.from_arrays([
                pa.array([None, *terms.tolist()], pa.string()),
                pa.array(np.concatenate(([label.sum()], toxic)).astype(np.int64)),
                pa.array(np.concatenate(([len(label) - label.sum()], both - toxic)).astype(np.int64)),
            ], names=["term", "toxic", "clean"])

    rows = sample.mapInArrow(counted, "term string, toxic long, clean long")
    return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _corpus_counts(docs: DataFrame, terms: list[str]) -> tuple[np.ndarray, int]:
    """Occurrences of ``terms`` in all documents, and all words.  What a task
    sends has a row per term it met, at most ``LEXICON`` + 1."""
    index = {t: k for k, t in enumerate(terms)}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms) + 1, np.int64)
        for batch in pieces(batches, "text"):
            words = split_words(batch.column("text"))
            if words.distinct:
                at = np.array([index.get(term(w), len(terms)) for w in words.distinct])
                total += np.bincount(at[words.codes], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["at", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(counted, "at long, n long")
    found = rows.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most LEXICON + 1 rows
    counts = np.zeros(len(terms) + 1, np.int64)
    counts[found["at"].to_numpy(int)] = found["n"].to_numpy(int)
    return counts[:-1], int(counts.sum())


def _log_odds(toxic, clean, docs_toxic, docs_clean, prior_share, prior):
    """Log-odds of a term between the labels under a Dirichlet prior, and their
    standard error."""
    a = prior * prior_share + LEAST
    up, down = toxic + a, clean + a
    gain = np.log(up / (docs_toxic + prior - up)) - np.log(down / (docs_clean + prior - down))
    return gain, np.sqrt(1 / up + 1 / down)


def _decay(shares: np.ndarray, gains: np.ndarray) -> float:
    """The positive root x of E[exp(x * score)] = 1 over the corpus."""
    rest = max(0.0, 1 - shares.sum())

    def over(x: float) -> bool:
        return rest * np.exp(-x * DRIFT) + (shares * np.exp(np.minimum(x * gains, 700))).sum() > 1

    low, high = 0.0, 1.0
    while not over(high) and high < 64:
        high *= 2
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) else (mid, high)
    return max(low, 1e-3)


def _curve(evidence: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number, by Newton steps with a little
    shrinkage; a row counts ``weight`` times."""
    x = np.column_stack([np.ones(len(y)), evidence])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w += np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-3 * w)
    return float(w[0]), float(max(w[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """The model, from ``sample_rows`` labelled rows of each label at most and
    counts over all documents."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = labelled(texts, labels, label, sample_rows, FOLDS, FOLD, once=True)  # a text that was copied has one vote
    sample = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "key"])  # narrow rows, bounded
    sample = sample.dropDuplicates(["text", "label"])  # at most 2 x sample_rows, also if an id is repeated
    counts = _label_counts(sample).filter((F.col("toxic") >= 2) | F.col("term").isNull())
    totals = counts.filter(F.col("term").isNull()).first()
    docs_toxic, docs_clean = (totals["toxic"], totals["clean"]) if totals else (0, 0)
    if not docs_toxic or not docs_clean:
        share = 0.99 if docs_toxic else 0.01
        return Toxicity({}, 1e-9, 1.0, float(np.log(share / (1 - share))), 0.0)
    lean = (F.col("toxic") / docs_toxic) / ((F.col("clean") + 1) / docs_clean)
    likely = counts.filter(F.col("term").isNotNull() & (F.col("term") != "") & (lean > 1.5))
    table = likely.orderBy((F.col("toxic") * F.log(lean)).desc(), "term").limit(LEXICON).toPandas()
    terms = table["term"].tolist()
    corpus, n_words = _corpus_counts(docs, terms)
    shares = corpus / max(n_words, 1)
    gain, error = _log_odds(
        table["toxic"].to_numpy(float), table["clean"].to_numpy(float), docs_toxic, docs_clean, shares, PRIOR
    )
    use = (gain > 1) & (gain / error >= Z)
    gains = {t: float(g) for t, g, u in zip(terms, gain, use) if u}
    rate = max(float(shares[use].sum()), 1e-9)
    model = Toxicity(gains, rate, _decay(shares[use], gain[use] - DRIFT) if gains else 1.0, 0.0, 1.0)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = model.evidence(split_words(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), batch.column("weight"), pa.array(found)], names=["label", "weight", "evidence"]
            )

    rows = sample.mapInArrow(evidence, "label int, weight double, evidence double").toPandas()
    base, slope = _curve(*(rows[c].to_numpy(float) for c in ("evidence", "label", "weight")))
    return model._replace(base=base, slope=slope)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """doc_id, held_out, score, predicted, and the significant passages
    (first and last word, score) of every row."""
    passage = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            words = split_words(batch.column("text"))
            passages = model.passages(words)
            s = model.scores(model.evidence(words, passages))
            found = [
                [p._asdict() for p in some if model.significant(p, n)]
                for some, n in zip(passages, np.diff(words.starts).tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(found, passage)],
                names=["doc_id", "score", "predicted", "passages"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = texts.mapInArrow(
        scored,
        "doc_id long, score double, predicted int, passages array<struct<first: long, last: long, score: double>>",
    )
    return rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", "predicted", "passages")
