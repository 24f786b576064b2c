"""Repeated passages by prefix-partitioned suffix trees.

Every word of every text begins a suffix.  Only nodes at depth ``DEPTH`` words
matter: a node there with two suffixes below it is a repeat, and one that holds
a document with a smaller id makes its window a copy.  Neighbouring windows
that are copies are the maximal repeats.

1. One pass counts the suffixes by prefixes of 1 to ``DEPTH`` words, in hashed
   classes.  The shortest prefix of a suffix whose class is at most
   ``GROUP_SUFFIXES`` strong decides its group; small classes share a group.
2. A second pass deals the suffixes to their groups.  A suffix travels as the
   fingerprint of its node (72 bits, beside the group's own class of another
   hash) and its place, packed in arrays.  Suffixes with a smaller document at
   the same node within a batch are known to be copies and stay behind, so a
   passage that a third of all rows share sends one document a batch.
3. Each group builds its part of the tree by sorting, finds the smallest
   document below each node, and returns the places of the copies, packed by
   parts of the rows.
4. The places of each row are gathered, join their text, and covered words are
   cut out.

Defined cases: null and empty texts and texts below ``DEPTH`` words have no
window; ids that are null come after all others and are equal to each other;
rows with equal ids are one document to each other (no smaller id), but each
keeps its own text; a window that repeats only within its document stays; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from quillmere.llm.words import hashes, mixed, pieces, split_words
from quillmere.session import planned_bytes, written

DEPTH = 13
PREFIXES = (1, 2, 3, 5, 8)  # words; the whole depth comes last
GROUP_SUFFIXES = 1_500_000
_NULL_ID = (1 << 63) - 1
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _prefix_hashes(h: np.ndarray, lengths: tuple[int, ...], base: int) -> Iterator[np.ndarray]:
    """Hash of the first words of each suffix, for each prefix length in turn;
    an entry for each suffix with as many words as the longest.  What is given
    is overwritten by the next."""
    count = max(0, len(h) - lengths[-1] + 1)
    total = h[:count].copy()
    with np.errstate(over="ignore"):
        for k in range(1, lengths[-1] + 1):
            if k > 1:
                total *= np.uint64(base)
                total += h[k - 1 : k - 1 + count]
            if k in lengths:
                yield total


class Plan(NamedTuple):
    """Which group a prefix class belongs to."""

    depth: int
    bits: int
    prefixes: tuple[int, ...]
    small: list[np.ndarray]  # by prefix: whether a class is small enough
    group: list[np.ndarray]  # by prefix: the group of a class
    groups: int

    def classes(self, h: np.ndarray) -> Iterator[np.ndarray]:
        for n, found in zip(self.prefixes, _prefix_hashes(h, self.prefixes, _BASES[1])):
            yield (mixed(found, n) >> np.uint64(64 - self.bits)).astype(np.int32)

    def groups_of(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Groups of the suffixes at ``at``."""
        out, open_ = np.empty(len(at), np.int32), np.arange(len(at))
        for small, group, found in zip(self.small, self.group, self.classes(h)):
            own = found[at[open_]]
            taken = small[own]
            out[open_[taken]] = group[own[taken]]
            open_ = open_[~taken]
            if not len(open_):
                break
        return out


def _prefixes(depth: int) -> tuple[int, ...]:
    return (*[n for n in PREFIXES if n < depth], depth)


def plan_groups(docs: DataFrame, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES) -> Plan:
    """Counts all suffixes by prefix class.  There are eight classes a group
    expected, so the counts, which come to the driver, grow with the groups
    and not with the rows."""
    expected = max(1, planned_bytes(docs) // (4 * group_suffixes))
    bits = max(10, min(20, int(expected).bit_length() + 3))
    prefixes = _prefixes(depth)
    blank = Plan(depth, bits, prefixes, [], [], 0)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(prefixes), 1 << bits), np.int64)
        for batch in pieces(batches, "text"):
            words = split_words(batch.column("text"))
            if len(words.codes) < depth:
                continue
            h = hashes(words.distinct)[words.codes]
            there = _windows(words.starts, depth)[: len(h) - depth + 1]
            for k, found in enumerate(blank.classes(h)):
                total[k] += np.bincount(found[there], minlength=1 << bits)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total.ravel()[met])], names=["at", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(counted, "at long, n long")
    found = rows.groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(prefixes) << bits, np.int64)
    counts[found["at"].to_numpy(int)] = found["n"].to_numpy(int)
    counts = counts.reshape(len(prefixes), 1 << bits)
    small = [c <= group_suffixes for c in counts]
    small[-1][:] = True
    # classes in turn fill groups up to their size; of a longer prefix's class only
    # the share that shorter prefixes leave open is expected
    left = [1.0, *[c[~ok].sum() / max(1, c.sum()) for c, ok in zip(counts, small)]]
    strength = np.concatenate([np.where(ok, c, 0) * f for c, ok, f in zip(counts, small, left)])
    number = ((np.cumsum(strength) - strength) // group_suffixes).astype(np.int64)
    group = list(number.astype(np.int32).reshape(counts.shape))
    return blank._replace(small=small, group=group, groups=int(number.max()) + 1)


def _windows(starts: np.ndarray, depth: int) -> np.ndarray:
    """Whether a window of ``depth`` words of one text begins at each word."""
    there = np.zeros(int(starts[-1]) + 1, np.int64)
    count = np.maximum(np.diff(starts) - depth + 1, 0)
    np.add.at(there, starts[:-1], count > 0)
    np.add.at(there, starts[:-1] + count, -(count > 0).astype(np.int64))
    return np.cumsum(there)[:-1] > 0


_SQUEEZE = "<QQQ"
_ROW = np.dtype([("doc", "<i8"), ("key", "<u4")])


def _planes(values: np.ndarray) -> bytes:
    """Numbers as their lowest bytes, then the next, and so on: small numbers
    leave runs of zeros."""
    return np.ascontiguousarray(values.view("u1").reshape(len(values), values.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind: str, count: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    found = np.frombuffer(raw, "u1", count * size, at).reshape(size, count)
    return np.ascontiguousarray(found.T).reshape(-1).view(kind)


def pack_places(table: np.ndarray, rows: np.ndarray, places: np.ndarray, extra: bytes = b"") -> bytes:
    """Places of several rows, ascending within a row, as bytes: the steps
    between the ids of the rows, their keys, how many places each has, and the
    steps between these."""
    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else np.empty(0, np.int64)
    steps = np.diff(places.astype(np.int64), prepend=0)
    steps[first] = places[first]
    own = table[rows[first]]
    parts = [
        np.diff(own["doc"], prepend=0).astype("<i8"), own["key"].astype("<u4"),
        np.diff(np.append(first, len(rows))).astype("<u4"), steps.astype("<u4"),
    ]
    packed = zstandard.compress(b"".join(map(_planes, parts)), 3)
    return struct.pack(_SQUEEZE, len(first), len(rows), len(extra)) + extra + packed


def unpack_places(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, memoryview]:
    """Rows (id, key), the row of each place, the places, and what came with them."""
    n_rows, n, size = struct.unpack_from(_SQUEEZE, data)
    raw = zstandard.decompress(data[24 + size :])
    rows = np.empty(n_rows, _ROW)
    rows["doc"] = np.cumsum(_unplaned(raw, "<i8", n_rows, 0))
    rows["key"] = _unplaned(raw, "<u4", n_rows, 8 * n_rows)
    counts = _unplaned(raw, "<u4", n_rows, 12 * n_rows).astype(np.int64)
    total = np.cumsum(_unplaned(raw, "<u4", n, 16 * n_rows).astype(np.int64))
    first = np.cumsum(counts) - counts
    before = np.concatenate(([0], total))[first]  # the steps of earlier rows
    return rows, np.repeat(np.arange(n_rows), counts), total - np.repeat(before, counts), memoryview(data)[24 : 24 + size]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (null ids last), text (never null) and the text's crc32."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.crc32("text").alias("key"), "text"
    )


def _dealt(docs: DataFrame, plan: Plan) -> DataFrame:
    """Suffixes of each group (kind 0), and copies found on the spot (kind 1)."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            batch = batch.take(pc.sort_indices(batch, [("doc_id", "ascending")]))
            words = split_words(batch.column("text"))
            if len(words.codes) < plan.depth:
                continue
            h = hashes(words.distinct)[words.codes]
            table = np.empty(batch.num_rows, _ROW)
            table["doc"] = batch.column("doc_id").to_numpy()
            table["key"] = batch.column("key").to_numpy()
            at = np.flatnonzero(_windows(words.starts, plan.depth))
            if not len(at):
                continue
            row = (np.searchsorted(words.starts, at, "right") - 1).astype(np.int32)
            place = at - words.starts[row]
            (node,) = _prefix_hashes(h, (plan.depth,), _BASES[0])
            (other,) = _prefix_hashes(mixed(h, 5), (plan.depth,), _BASES[1])
            group, node, more = plan.groups_of(h, at), node[at], (mixed(other[at]) >> np.uint64(56)).astype(np.uint8)
            del h, other
            # the first of equal nodes has the smallest document, as rows are in order
            order = np.argsort(node, kind="stable")
            new = np.concatenate(([True], node[order][1:] != node[order][:-1]))
            least = table["doc"][row[order[np.flatnonzero(new)]]][np.cumsum(new) - 1]
            copy = np.zeros(len(at), bool)
            copy[order] = table["doc"][row[order]] > least
            kinds, groups, data = [], [], []
            if copy.any():
                kinds.append(1)
                groups.append(int(node[0] % np.uint64(plan.groups)))
                data.append(pack_places(table, row[copy], place[copy]))
            stays = np.flatnonzero(~copy)
            stays = stays[np.argsort(group[stays], kind="stable")]
            for some in np.split(stays, np.flatnonzero(np.diff(group[stays])) + 1) if len(stays) else ():
                kinds.append(0)
                groups.append(int(group[some[0]]))
                data.append(pack_places(table, row[some], place[some], node[some].astype("<u8").tobytes() + more[some].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(groups, pa.int32()), pa.array(kinds, pa.int32()), pa.array(data, pa.binary())],
                names=["group", "kind", "data"],
            )

    return _keyed(docs).mapInArrow(suffixes, "group int, kind int, data binary")


def _packed(table: np.ndarray, row: np.ndarray, place: np.ndarray, parts: int) -> pd.DataFrame:
    """Places by part of the rows, a row of bytes for each part."""
    part = (mixed(table["doc"].view(np.uint64) ^ table["key"].astype(np.uint64), 7) % np.uint64(parts)).astype(np.int32)
    order = np.lexsort((place, row, part[row]))
    row, place = row[order], place[order]
    ends = np.flatnonzero(np.diff(part[row])) + 1
    bounds = [0, *ends.tolist(), len(row)] if len(row) else [0]
    return pd.DataFrame({
        "part": [int(part[row[a]]) for a in bounds[:-1]],
        "data": [pack_places(table, row[a:b], place[a:b]) for a, b in zip(bounds, bounds[1:])],
    })


def _subtree(group: pd.DataFrame, parts: int) -> pd.DataFrame:
    """Places of the copies among a group's suffixes, by part of the rows."""
    out = []
    tables, rows, places, nodes, more = [], [], [], [], []
    base = 0
    for kind, data in zip(group["kind"], group["data"]):
        table, row, place, extra = unpack_places(data)
        if kind:
            out.append(_packed(table, row, place, parts))
            continue
        n = len(row)
        tables.append(table)
        rows.append((row + base).astype(np.int32))
        places.append(place.astype(np.int32))
        nodes.append(np.frombuffer(extra, "<u8", n))
        more.append(np.frombuffer(extra, "u1", n, 8 * n))
        base += len(table)
    if nodes:
        table, row, place = np.concatenate(tables), np.concatenate(rows), np.concatenate(places)
        node, more_bits = np.concatenate(nodes), np.concatenate(more)
        del tables, rows, places, nodes, more
        order = np.lexsort((more_bits, node))
        node, more_bits = node[order], more_bits[order]
        new = np.ones(len(order), bool)
        new[1:] = (node[1:] != node[:-1]) | (more_bits[1:] != more_bits[:-1])
        del node, more_bits
        doc = table["doc"][row[order]]
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
        copies = order[doc > least]
        out.append(_packed(table, row[copies], place[copies], parts))
    return pd.concat(out) if out else pd.DataFrame({"part": [], "data": []})


def _gathered(part: pd.DataFrame) -> pd.DataFrame:
    """All places of each row of a part."""
    found = [unpack_places(data)[:3] for data in part["data"]]
    keys = np.concatenate([table[row] for table, row, _ in found])
    places = np.concatenate([place for _, _, place in found])
    order = np.lexsort((places, keys["key"], keys["doc"]))
    keys, places = keys[order], places[order]
    ends = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    first = np.concatenate(([0], ends)).astype(np.int64)
    return pd.DataFrame({
        "doc_id": keys["doc"][first].astype(np.int64), "key": keys["key"][first].astype(np.int64),
        "places": [zstandard.compress(np.unique(p).astype("<u4").tobytes(), 1) for p in np.split(places, ends)],
    })


def copies(docs: DataFrame, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES) -> DataFrame:
    """doc_id, key, places: the first words of the copied windows of each row
    that has any.  There are twice as many parts of rows as groups of suffixes,
    so a part's places are about as many as a group's or fewer."""
    plan = plan_groups(docs, depth, group_suffixes)
    parts = 2 * plan.groups
    found = _dealt(docs, plan).groupBy("group").applyInPandas(lambda g: _subtree(g, parts), "part int, data binary")
    rows = found.groupBy("part").applyInPandas(_gathered, "doc_id long, key long, places binary")
    return written(rows, "copied-windows")


def _covered(starts: np.ndarray, found: list, depth: int) -> np.ndarray:
    """Which words lie in a copied window."""
    copied = np.zeros(int(starts[-1]) + 1, np.int64)
    for first, places in zip(starts.tolist(), found):
        if places is not None:
            copied[first + np.frombuffer(zstandard.decompress(places), "<u4").astype(np.int64)] = 1
    total = np.concatenate((np.zeros(depth, np.int64), np.cumsum(copied[:-1])))
    return total[depth:] > total[:-depth]


def remove_repeats(
    docs: DataFrame, depth: int = DEPTH, group_suffixes: int = GROUP_SUFFIXES, with_text: bool = False
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by a
    space), spans (first and last word of each maximal repeat) and, if asked
    for, the text that is left."""
    found = copies(docs, depth, group_suffixes)

    def squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches, "text"):
            small = [press.compress(t.as_buffer()) for t in batch.column("text")]
            yield batch.set_column(2, "text", pa.array(small, pa.binary()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2 << 20):
            texts = pa.array([zstandard.decompress(t).decode() for t in batch.column("text").to_pylist()], pa.string())
            lists = pc.ascii_split_whitespace(texts)
            flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
            real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(real)))[ends]
            flat = flat.filter(pa.array(real))
            gone = _covered(starts, batch.column("places").to_pylist(), depth)
            kept = np.concatenate(([0], np.cumsum(~gone)))[starts]
            left = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), flat.filter(pa.array(~gone))), " ")
            edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
            edge_at = np.union1d(np.flatnonzero(edge), starts)  # a span ends with its text
            spans: list[list[dict]] = [[] for _ in texts]
            for a, b in zip(edge_at.tolist(), edge_at[1:].tolist()):
                if gone[a]:
                    row = int(np.searchsorted(starts, a, "right")) - 1
                    spans[row].append({"first": a - int(starts[row]), "last": b - 1 - int(starts[row])})
            left_list = left.to_pylist()
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_words": pa.array(np.diff(starts)),
                "n_removed": pa.array(np.diff(starts) - np.diff(kept)),
                "kept_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in left_list]),
                "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
            }
            if with_text:
                columns["text"] = left
            yield pa.RecordBatch.from_pydict(columns)

    texts = _keyed(docs).mapInArrow(squeezed, "doc_id long, key long, text binary")
    joined = texts.join(found, ["doc_id", "key"], "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first: long, last: long>>"
    rows = joined.select("doc_id", "text", "places").mapInArrow(cut, schema + ", text string" * with_text)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != _NULL_ID, F.col("doc_id")))
