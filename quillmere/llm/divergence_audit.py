"""How the sources of a language differ in their terms, by dominance skybands.

Terms are counted per language and source; a language keeps the terms that are
in enough of its documents.  A group (a language and a source) or a language
gives each kept term the smoothed share ``1 + floor(scale * (count + pseudo) /
(N + pseudo * V))``, V being the kept terms and N their count.  Two reports:

* ``pair``: for each group the other sources of its language, by the summed
  difference of shares over all kept terms;
* ``term``: for each group its terms whose share is above the language's, by
  the difference, the first ``top`` of them.

The second uses that a share grows with its count: a term is behind another
one for certain if that has no smaller count in the group, no larger one in the
language, and the earlier UTF-8.  Each part of a group's terms keeps its
skyband, the terms that fewer than ``top`` others dominate so; skybands of
parts are merged and thinned again, and what is left is ranked exactly.

For the first, terms of a language are dealt out in blocks; a block is a matrix
of shares, in which a source without a term has its share of the count 0.

All arithmetic is of whole numbers; floor divisions go three decimal digits at
a time, so counts up to 9 * 10^15 stay exact.

Defined cases: null text, lang and source are ''; rows with equal or null ids
are documents of their own; a group without terms, or of a language that keeps
none, is still an item with value 0; an empty table gives an empty result; only
``text``, ``lang`` and ``source`` are read, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from quillmere.llm.words import pieces, split_words
from quillmere.session import written

MIN_DOCS = 30  # documents of a language that hold a kept term
PSEUDO = 5  # added to each count
SCALE_STEPS = 3  # shares in 1000 ** SCALE_STEPS-ths
TOP = 50
PART_TERMS = 20_000  # terms of one group in a skyband task
BLOCK_CELLS = 4_000_000  # terms x sources in a block of shares, at most
BLOCK_TERMS = 512  # terms in a block; where a language has more sources, as many as these
PIECE_BYTES = 16 << 20
STRIDE = 256  # terms held against the skyband at once

# Bytes that are no part of a term become spaces, A-Z become a-z.
_FOLDED = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def folded(texts: pa.Array) -> pa.Array:
    """Texts whose terms are lower-case and parted by spaces alone."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = bytes(memoryview(body)[offsets[0] : offsets[-1]]) if body is not None else b""
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(data.translate(_FOLDED)))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs of every group's terms,
    and a row with a null term for every group."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            width = len(sources.dictionary)
            group = langs.indices.to_numpy().astype(np.int64) * width + sources.indices.to_numpy()
            words = split_words(folded(batch.column("text")))
            size = max(1, len(words.distinct))
            text = words.texts()
            cells, n = np.unique(group[text] * size + words.codes, return_counts=True)
            once = np.unique(text * size + words.codes)
            docs_of = np.unique(group[once // size] * size + once % size, return_counts=True)[1]
            there = np.unique(group)
            key = np.concatenate((cells // size, there))
            yield pa.record_batch({
                "lang": langs.dictionary.take(pa.array(key // width)),
                "source": sources.dictionary.take(pa.array(key % width)),
                "term": pa.concat_arrays([
                    pa.array(words.distinct, pa.string()).take(pa.array(cells % size)), pa.nulls(len(there), pa.string())
                ]),
                "n": np.concatenate((n, np.zeros(len(there), np.int64))),
                "docs": np.concatenate((docs_of, np.zeros(len(there), np.int64))),
            })

    named = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(1000 ** SCALE_STEPS * (count + PSEUDO) / (total + PSEUDO * terms))`` in whole numbers."""
    whole = total + PSEUDO * terms
    done, rest = F.lit(0).cast("long"), count + PSEUDO
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        done = done * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return done + 1


def dominated(counts: np.ndarray, lang_counts: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Whether ``k`` others have no smaller count, no larger one in the
    language, and an earlier name (a rank).  Others that are dominated
    themselves need not be looked at: what dominates them is there."""
    order = np.lexsort((names, lang_counts, -counts))  # a dominating term comes before
    lang, name = lang_counts[order], names[order]
    out = np.zeros(len(order), bool)
    band = np.empty(0, np.int64)
    for at in range(0, len(order), STRIDE):
        now = np.arange(at, min(at + STRIDE, len(order)))
        over = (lang[band, None] <= lang[now]) & (name[band, None] < name[now])
        within = (lang[now, None] <= lang[now]) & (name[now, None] < name[now]) & (now[:, None] < now)
        beaten = over.sum(0) + within.sum(0) >= k
        out[order[now]] = beaten
        band = np.concatenate((band, now[~beaten]))
    return out


def skybands(terms: DataFrame, k: int = TOP, part_terms: int = PART_TERMS) -> DataFrame:
    """The terms (lang, source, term, n, lang_n) of each group that fewer than
    ``k`` of its terms dominate, or a few more: parts of a group are thinned on
    their own and dealt anew until a group is one part or nothing falls away."""

    def thin(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        names = np.empty(part.num_rows, np.int64)
        names[pc.sort_indices(part["term"].combine_chunks().cast(pa.binary())).to_numpy()] = np.arange(part.num_rows)
        away = dominated(part["n"].to_numpy(), part["lang_n"].to_numpy(), names, k)
        return part.filter(pa.array(~away)).drop_columns(["part"])

    schema = "lang string, source string, term string, n long, lang_n long"
    band, before, last = terms.select("lang", "source", "term", "n", "lang_n"), math.inf, 0
    while True:
        parts = band.groupBy("lang", "source").agg(F.count("*").alias("size")).withColumn(
            "parts", F.ceil(F.col("size") / part_terms))
        most, rows = parts.agg(F.max("parts"), F.sum("size")).first()
        if most is None or last == 1 or rows > 0.9 * before:
            return band
        before, last = rows, most
        dealt = band.join(parts.drop("size"), ["lang", "source"]).withColumn(
            "part", F.pmod(F.xxhash64("term"), F.col("parts"))).drop("parts")
        band = written(dealt.groupBy("lang", "source", "part").applyInArrow(thin, schema), "skyband")


def pair_values(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: the summed difference of shares of every two
    sources of a language, in both directions."""
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("n_terms").alias("terms"))
    # with as many terms as sources, the sums of a block are no more than half its cells
    wide = F.least(F.greatest(F.lit(BLOCK_TERMS), "sources"), F.ceil(F.lit(BLOCK_CELLS) / F.col("sources")))
    blocks = sizes.select("lang", F.greatest(F.lit(1), F.ceil(F.col("terms") / wide)).alias("blocks"))
    cells = terms.join(groups, ["lang", "source"]).join(blocks, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term",
        share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p"))
    bases = groups.join(blocks, "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source",
        F.when(F.col("n_terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("n_terms"))).otherwise(0).alias("p"))

    def differ(key: tuple, cells: pa.Table, bases: pa.Table) -> pa.Table:
        names = bases["source"].combine_chunks()
        base = bases["p"].to_numpy()
        term = cells["term"].combine_chunks().dictionary_encode()
        shares = np.tile(base[:, None], (1, len(term.dictionary)))
        row = pc.index_in(cells["source"].combine_chunks(), names).to_numpy()
        shares[row, term.indices.to_numpy()] = cells["p"].to_numpy()
        first, second, value = [], [], []
        for k in range(len(base) - 1):
            first.append(np.full(len(base) - 1 - k, k))
            second.append(np.arange(k + 1, len(base)))
            value.append(np.abs(shares[k + 1 :] - shares[k]).sum(1))
        whole = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        first, second, value = whole(first), whole(second), whole(value)
        return pa.table({
            "lang": pa.array([key[0].as_py()] * len(value), pa.string()), "source": names.take(pa.array(first)),
            "item": names.take(pa.array(second)), "value": pa.array(value, pa.int64()),
        })

    sums = cells.groupBy("lang", "block").cogroup(bases.groupBy("lang", "block")).applyInArrow(
        differ, "lang string, source string, item string, value long")
    once = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    turned = once.select("lang", F.explode(both).alias("x"), "value")
    return turned.select("lang", F.col("x.source").alias("source"), F.col("x.item").alias("item"), "value")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank."""
    counts = written(term_counts(docs), "term-counts")
    some = counts.filter(F.col("term").isNotNull())
    kept = some.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(
        F.col("docs") >= min_docs).drop("docs")
    terms = written(some.drop("docs").join(kept, ["lang", "term"]), "kept-terms")
    sums = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a kept term has one row per source; the smallest stands for the language
    langs = terms.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(
        F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    groups = written(
        counts.filter(F.col("term").isNull()).select("lang", "source").join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left").fillna(0, ["total", "n_terms", "lang_total"]), "groups")
    pairs = pair_values(terms, groups.drop("lang_total")).withColumn("part", F.lit("pair"))
    value = share(F.col("n"), F.col("total"), F.col("n_terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms"))
    over = skybands(terms, top).join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), value.alias("value"), F.lit("term").alias("part")
    ).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    first = over.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first).select(
        "lang", "source", "part", "item", "value", "rank")
