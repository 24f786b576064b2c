"""Cosine top-k of a table of questions over a table of vectors.

The vectors are read once, never shuffled, and no pair is written out.  The
questions are written to the shared folder in blocks of a bounded size; each
scan task holds a bounded stretch of vectors and streams the blocks past it,
one matrix product after the other.  It hands over at most k rows per question
and stretch, and a ranking in two steps over those rows ends the job.  The
driver sees how many questions there are, not the questions.  Tasks open the
blocks with pyarrow, so the shared folder must be one that it reads (a mounted
path, or a store it has a file system for).

The matrix product only picks candidates.  What is ranked is each candidate's
own product, summed in one order, so equal vectors have equal scores wherever
they lie.

A question is compared with the vectors of its own length.  Vectors and
questions that hold a null, NaN or infinite number have no hits
(``embedding.dimension_rejects`` and ``unusable`` list them).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from quillmere.session import shared_dir, written

BLOCK_BYTES = 64 << 20  # question vectors held by one task
HELD_BYTES = 64 << 20  # vectors held, as they are multiplied, while the blocks go past
HELD_ROWS = 4096  # vectors made ready at once
PUSHED_VALUES = 1000  # of a match column that are sent to the scan as a filter
RANK_PARTS = 64  # of the hits of a question, ranked by themselves first
TILE_CELLS = 1 << 21  # scores held at a time
SCORE_DIGITS = 6  # scores are compared after rounding; ties go to the lowest id
SLACK = 2e-6  # by which a product may be short and still be a candidate: more than rounding and summing can move it


@dataclass
class _Best:
    """Best k rows per question seen by one task."""

    k: int
    questions: int
    parts: list = field(default_factory=list)
    waiting: int = 0

    def __post_init__(self):
        self.floor = np.full(self.questions, -np.inf)

    def offer(self, ids: pa.Array, which: np.ndarray, scores: np.ndarray, exact: Callable) -> None:
        """Rows by questions; ``exact`` gives the scores of (row, question) pairs."""
        floor = self.floor[which]
        if len(scores) > self.k:
            top = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
            floor = np.maximum(floor, top)
        rows, cols = np.nonzero((scores >= floor - SLACK) & (scores > -np.inf))
        if len(rows):
            self.parts.append(
                pa.table({"q": which[cols], "score": exact(rows, cols), "id": ids.take(pa.array(rows))})
            )
            self.waiting += len(rows)
            if self.waiting > max(4 * self.k * self.questions, 1 << 18):
                self.shrink()

    def shrink(self) -> None:
        if not self.parts:
            return
        table = pa.concat_tables(self.parts).sort_by(
            [("q", "ascending"), ("score", "descending"), ("id", "ascending")]
        )
        q = table["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        table = table.filter(pa.array(place < self.k))
        full = place[place < self.k] == self.k - 1
        self.floor[table["q"].to_numpy()[full]] = table["score"].to_numpy()[full]
        self.parts, self.waiting = [table.combine_chunks()], 0


def _unit_rows(vectors: pa.Array) -> np.ndarray:
    """List column to a matrix of unit rows; a zero vector stays zero."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    if not len(vectors):
        return np.zeros((0, 0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def unusable(embedding: Column) -> Column:
    """Whether a vector is null, empty, or holds a null, NaN or infinite number."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) <= 0) | bad, F.lit(True))


@dataclass
class _Asked:
    """The usable questions as written blocks of each vector length."""

    folder: str
    blocks: list[tuple[int, int]]  # (length, number of blocks)
    most: int  # hits there can be
    largest: int  # number of results of one question

    def path(self, width: int, block: int) -> str:
        return f"{self.folder}/width={width}/block={block}"


def _ask(questions: DataFrame) -> _Asked:
    """Write the questions (with ``_k``) in blocks of about ``BLOCK_BYTES``."""
    numbered = questions.withColumn("_n", F.monotonically_increasing_id()).withColumn("width", F.size("embedding"))
    stored = written(numbered.filter(~unusable(F.col("embedding").cast("array<double>"))), "questions")
    sizes = stored.groupBy("width").agg(
        F.count("*").alias("n"), F.max("_k").alias("k"), F.sum("_k").alias("hits")).collect()  # a row per length
    blocks = [(r["width"], -(-r["n"] * 8 * r["width"] // BLOCK_BYTES)) for r in sorted(sizes, key=lambda r: r["width"])]
    folder = shared_dir(questions.sparkSession, "question-blocks")
    if blocks:
        count = F.create_map(*[F.lit(x) for pair in blocks for x in pair])[F.col("width")]
        dealt = stored.withColumn("block", F.pmod(F.xxhash64("_n"), count)).drop("_n")
        dealt.repartition("width", "block").write.partitionBy("width", "block").parquet(folder)
    return _Asked(folder, blocks, sum(r["hits"] or 0 for r in sizes), max([r["k"] or 0 for r in sizes] + [1]))


def _block(path: str) -> pa.Table | None:
    """A block of questions, read in a task."""
    from pyarrow import fs, parquet

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, place = (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if f.path.endswith(".parquet")]
    if not found:  # by chance no question fell into it
        return None
    return pa.concat_tables([parquet.read_table(f, filesystem=store, partitioning=None) for f in sorted(found)])


def _scanner(asked: _Asked, filters: Sequence[str], probe: Callable | None, out: pa.Schema):
    """The per-task function: Arrow batches of vectors in, best rows out.

    ``probe`` gives, for a block and its unit rows, the cells (cells x
    questions, boolean) that each question looks into.
    """

    def usable_rows(batch: pa.RecordBatch, width: int) -> tuple[pa.RecordBatch, np.ndarray]:
        # checked here: a Spark filter on a computed vector would run its encoder a second time
        batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), width))
        matrix = _unit_rows(batch.column("embedding"))
        batch = batch.select([name for name in batch.schema.names if name != "embedding"])
        finite = np.isfinite(matrix).all(axis=1)
        return (batch, matrix) if finite.all() else (batch.filter(pa.array(finite)), matrix[finite])

    def by_cell(cells: np.ndarray | None, rows: int, probes: np.ndarray | None, questions: int):
        if probes is None:
            yield np.arange(rows), np.arange(questions)
            return
        order = np.argsort(cells, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
            asking = np.flatnonzero(probes[cells[some[0]]])
            if len(asking):
                yield some, asking

    def hits(held: list, block: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = _unit_rows(block["embedding"])
        block_k = max(pc.max(block["_k"]).as_py() or 0, 1)
        probes = probe(block, wanted) if probe else None
        matches = [
            [(value, np.flatnonzero(np.array([v == value for v in column])))
             for value in sorted({v for v in column if v is not None})]
            for column in (block[name].to_pylist() for name in filters)
        ]
        best = _Best(block_k, len(wanted))
        for batch, matrix in held:
            ids = batch.column("vector_id")
            cells = batch.column("cell").to_numpy(zero_copy_only=False) if probe else None
            allowed = [
                [(np.array(pc.equal(batch.column(name), value).fill_null(False)), who)
                 for value, who in groups]
                for name, groups in zip(filters, matches)
            ]
            for rows, asking in by_cell(cells, batch.num_rows, probes, len(wanted)):
                tile = max(TILE_CELLS // len(asking), block_k + 1)
                for at in range(0, len(rows), tile):
                    part = rows[at : at + tile]
                    scores = matrix[part] @ wanted[asking].T
                    for groups in allowed:
                        for passing, who in groups:
                            here = np.isin(asking, who)
                            scores[np.ix_(~passing[part], here)] = -np.inf
                    exact = lambda r, c: _products(matrix, wanted, part[r], asking[c])  # noqa: B023, E731
                    best.offer(ids.take(pa.array(part)), asking, scores, exact)
        best.shrink()
        for table in best.parts:
            q = table["q"].combine_chunks()
            own = [block[c].combine_chunks().take(q) for c in ("question_id", "_k", "_threshold")]
            columns = [own[0], table["id"], table["score"], own[1], own[2]]
            yield from pa.table(
                [c.cast(f.type) for c, f in zip(columns, out)], schema=out
            ).combine_chunks().to_batches()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None  # the last block is kept: one block is read once

        def pass_blocks(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            nonlocal at, block
            for width, blocks in asked.blocks:
                for path in [asked.path(width, k) for k in range(blocks if held[width] else 0)]:
                    if path != at:
                        at, block = path, _block(path)
                    if block is not None:
                        yield from hits(held[width], block)

        none = lambda: {width: [] for width, _ in asked.blocks}
        held, size = none(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, HELD_ROWS):
                for width, _ in asked.blocks:
                    rows, matrix = usable_rows(batch.slice(first, HELD_ROWS), width)
                    if rows.num_rows:
                        held[width].append((rows, matrix))
                        size += rows.nbytes + matrix.nbytes
                if size >= HELD_BYTES:
                    yield from pass_blocks(held)
                    held, size = none(), 0
        yield from pass_blocks(held)

    return scan


def _products(a: np.ndarray, b: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Rounded products of pairs of rows, each summed in the same order."""
    step = max(1, TILE_CELLS // a.shape[1])
    parts = [(a[rows[i : i + step]] * b[cols[i : i + step]]).sum(axis=1) for i in range(0, len(rows), step)]
    return np.round(np.concatenate(parts), SCORE_DIGITS) + 0.0


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StringType):
        return pa.string()
    if isinstance(kind, T.IntegerType):
        return pa.int32()
    if isinstance(kind, T.LongType):
        return pa.int64()
    raise TypeError(f"ids must be strings or integers, not {kind.simpleString()}")


def _hits(vectors: DataFrame, asked: _Asked, question_type: T.DataType, names: Sequence[str], probe: Callable | None) -> DataFrame:
    """The best rows that the tasks hand over for the asked questions, from
    one scan of the vectors."""
    filters = [f"_f_{c}" for c in names]
    ids = vectors.schema["id"].dataType, question_type
    out = pa.schema(
        [("question_id", _arrow_type(ids[1])), ("vector_id", _arrow_type(ids[0])), ("score", pa.float64()),
         ("_k", pa.int32()), ("_threshold", pa.float64())]
    )
    result_type = T.StructType(
        [T.StructField("question_id", ids[1]), T.StructField("vector_id", ids[0]),
         T.StructField("score", T.DoubleType()), T.StructField("_k", T.IntegerType()),
         T.StructField("_threshold", T.DoubleType())]
    )
    columns = [
        F.col("id").alias("vector_id"), "embedding",
        *[F.col(c).cast("string").alias(f"_f_{c}") for c in names], *(["cell"] if probe else []),
    ]
    return vectors.select(*columns).mapInArrow(_scanner(asked, filters, probe, out), result_type)


def _questions(questions, k, match, threshold, dimension):
    own_k = F.col(k) if isinstance(k, str) else F.lit(k)
    own_threshold = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    q = questions.select(
        "question_id", "embedding", own_k.cast("int").alias("_k"), own_threshold.cast("double").alias("_threshold"),
        *[F.col(match[c]).cast("string").alias(f"_f_{c}") for c in match],
    )
    return q if dimension is None else q.filter(F.size("embedding") == dimension)


def _pushed(questions: DataFrame, vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """The vectors that a match column leaves, as a filter of the scan where
    every question asks for one of few values."""
    for c in names:
        values = [r[0] for r in questions.select(f"_f_{c}").distinct().limit(PUSHED_VALUES + 1).collect()]
        if None not in values and len(values) <= PUSHED_VALUES:
            vectors = vectors.filter(F.col(c).cast("string").isin(values))
    return vectors


def _search(questions, vectors, k, match, threshold, dimension=None):
    q = _questions(questions, k, match, threshold, dimension)
    asked = _ask(q)
    found = _hits(_pushed(q, vectors, list(match)), asked, q.schema["question_id"].dataType, list(match), None)
    return _rank_own(found, asked.largest), asked.most


def _rank_own(hits: DataFrame, most: int) -> DataFrame:
    """Rank the hits of each question up to its own ``_k`` and ``_threshold``,
    part by part first, so that a question with hits from very many tasks is
    not one task's work."""
    order = [F.desc("score"), F.asc("vector_id")]
    part = F.pmod(F.xxhash64("vector_id"), F.lit(RANK_PARTS))
    first = Window.partitionBy("question_id", part).orderBy(*order)
    kept = hits.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= most).drop("rank")
    ranked = rank_hits(kept, most).filter(F.col("rank") <= F.col("_k"))
    enough = F.col("_threshold").isNull() | (F.col("score") >= F.col("_threshold"))
    return ranked.filter(enough).drop("_k", "_threshold")


def rank_hits(hits: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """Rank by score, then lowest id; the threshold applies after the cut."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("vector_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked if threshold is None else ranked.filter(F.col("score") >= threshold)


def top_k(
    questions: DataFrame,
    vectors: DataFrame,
    k: int | str = 5,
    threshold: float | str | None = None,
    where: Column | None = None,
    match: dict[str, str] | None = None,
    dimension: int | None = None,
) -> DataFrame:
    """Exact search: question_id, vector_id, score, rank.

    ``questions`` has question_id and embedding, ``vectors`` id and embedding.
    ``where`` filters the vectors before ranking; ``match`` maps a vector
    column to the question column it must equal (null: no restriction).  ``k``
    and ``threshold`` may name question columns, so that each question brings
    its own (null threshold: none).  With ``dimension`` questions of another
    length are left out.
    """
    return top_k_bounded(questions, vectors, k, threshold, where, match, dimension)[0]


def top_k_bounded(
    questions: DataFrame,
    vectors: DataFrame,
    k: int | str = 5,
    threshold: float | str | None = None,
    where: Column | None = None,
    match: dict[str, str] | None = None,
    dimension: int | None = None,
) -> tuple[DataFrame, int]:
    """As ``top_k``, with the most hits there can be."""
    rows = vectors if where is None else vectors.filter(where)
    return _search(questions, rows, k, match or {}, threshold, dimension=dimension)


def train_cells(
    vectors: DataFrame, cells: int = 1024, iterations: int = 10, seed: int = 42, dimension: int | None = None,
    most_rows: int | None = None,
) -> np.ndarray:
    """Unit centroids by distributed k-means (cells x dimension numbers), from
    the usable vectors of the most common length, or of ``dimension``, that
    are not zero.  ``assign_cells`` puts zero vectors in the first cell.

    A cell of more than ``most_rows`` rows gives way to cells of its own rows;
    one whose rows are all alike stays as it is."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    numbers = F.col("embedding").cast("array<double>")
    good = vectors.select(numbers.alias("embedding")).filter(~unusable(F.col("embedding")))
    if dimension is None:
        dimension = good.agg(F.mode(F.size("embedding"))).first()[0]
    not_zero = F.exists("embedding", lambda x: x != 0)
    good = good.filter((F.size("embedding") == dimension) & not_zero)

    def centres(rows: DataFrame, k: int) -> np.ndarray:
        model = KMeans(k=k, maxIter=iterations, seed=seed, distanceMeasure="cosine").fit(
            rows.select(array_to_vector("embedding").alias("features")))
        found = np.array(model.clusterCenters())
        return found / np.linalg.norm(found, axis=1, keepdims=True)

    found = centres(good, cells)
    if most_rows is None:
        return found
    placed = written(assign_cells(good, found), "placed")
    large = placed.groupBy("cell").count().filter(F.col("count") > most_rows).collect()  # fewer rows than cells
    parts = {r["cell"]: centres(placed.filter(F.col("cell") == r["cell"]), -(-r["count"] // most_rows)) for r in large}
    return np.concatenate([parts.get(c, found[c : c + 1]) for c in range(len(found))])


def assign_cells(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Add the number of the nearest centroid; null for a vector of another
    length."""

    @F.arrow_udf("int")
    def nearest(embedding: pa.Array) -> pa.Array:
        fits = np.array(pc.equal(pc.list_value_length(embedding), centroids.shape[1]).fill_null(False))
        cells = np.zeros(len(embedding), dtype=np.int32)
        if fits.any():
            matrix = _unit_rows(embedding.filter(pa.array(fits)))
            scores = np.nan_to_num(np.round(matrix @ centroids.T, 9))
            cells[fits] = scores.argmax(axis=1)
        return pa.array(cells, mask=~fits)

    return vectors.withColumn("cell", nearest("embedding"))


def write_cells(indexed: DataFrame, path: str) -> None:
    """One folder per cell; the rebalance hint lets AQE split a hot cell over
    several writers and merge small ones."""
    indexed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(path)


def cell_reach(indexed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cell, n, lowest (the smallest cosine of a vector in the cell to its
    centroid) and zeros (vectors without a direction): a row per cell, to be
    kept with the cells."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, zeros = (np.zeros(len(centroids), np.int64) for _ in range(2))
        lowest = np.ones(len(centroids))
        for batch in batches:
            batch = batch.filter(pc.equal(pc.list_value_length(batch.column("embedding")), centroids.shape[1]))
            matrix = _unit_rows(batch.column("embedding"))
            there = np.isfinite(matrix).all(axis=1) if len(matrix) else np.zeros(0, bool)
            matrix, cells = matrix[there], batch.column("cell").to_numpy(zero_copy_only=False)[there].astype(np.int64)
            flat = ~matrix.any(axis=1) if len(matrix) else there
            np.add.at(n, cells, 1)
            np.add.at(zeros, cells[flat], 1)
            np.minimum.at(lowest, cells[~flat], (matrix[~flat] * centroids[cells[~flat]]).sum(axis=1))
        met = np.flatnonzero(n)
        yield pa.record_batch({"cell": met.astype(np.int32), "n": n[met], "lowest": lowest[met], "zeros": zeros[met]})

    parts = indexed.filter(F.col("cell").isNotNull()).select("embedding", "cell").mapInArrow(
        measure, "cell int, n long, lowest double, zeros long")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.min("lowest").alias("lowest"), F.sum("zeros").alias("zeros"))


def _nearest_cells(centroids: np.ndarray, nprobe: int) -> Callable:
    def probe(block: pa.Table, wanted: np.ndarray) -> np.ndarray:
        near = wanted @ centroids.T
        order = np.argsort(-near, axis=1, kind="stable")[:, :nprobe]
        probes = np.zeros(near.T.shape, dtype=bool)
        probes[order, np.arange(len(order))[:, None]] = True
        return probes

    return probe


def _further_cells(centroids: np.ndarray, nprobe: int, lowest: np.ndarray, zeros: np.ndarray) -> Callable:
    """The cells that may hold a hit and are not among the nearest: no vector
    of a cell is nearer to a question than the angle to the centroid less the
    cell's widest angle."""
    first = _nearest_cells(centroids, nprobe)
    reach = np.arccos(np.clip(lowest, -1, 1))

    def probe(block: pa.Table, wanted: np.ndarray) -> np.ndarray:
        angle = np.arccos(np.clip(wanted @ centroids.T, -1, 1))
        best = np.cos(np.maximum(angle - reach, 0.0))
        best = np.where(zeros > 0, np.maximum(best, 0.0), best)
        flat = ~wanted.any(axis=1)
        best[flat] = 0.0  # a question without a direction scores 0 everywhere
        floor = np.maximum(
            block["_floor"].to_numpy(zero_copy_only=False), pc.fill_null(block["_threshold"], -np.inf).to_numpy(zero_copy_only=False))
        return (best >= floor[:, None] - SLACK).T & ~first(block, wanted)

    return probe


def _probed(questions: DataFrame, vectors: DataFrame, probe: Callable, cells: int) -> DataFrame:
    """The vectors of the cells that any question looks into, as a filter of
    the scan; the driver sees the numbers of these cells."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(cells, bool)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            met |= probe(table, _unit_rows(table["embedding"])).any(axis=1)
        yield pa.record_batch({"cell": np.flatnonzero(met).astype(np.int32)})

    found = questions.filter(~unusable(F.col("embedding").cast("array<double>"))).mapInArrow(asked, "cell int").distinct()
    return vectors.filter(F.col("cell").isin([r["cell"] for r in found.collect()]))


def search_cells(
    questions: DataFrame,
    indexed: DataFrame,
    centroids: np.ndarray,
    k: int | str = 5,
    nprobe: int = 10,
    threshold: float | str | None = None,
    match: dict[str, str] | None = None,
    reach: DataFrame | None = None,
) -> DataFrame:
    """Search the ``nprobe`` nearest cells of each question, exact inside them.
    On a table written by ``write_cells`` the other cells are not read.

    With ``reach`` (from ``cell_reach``, brought here: a row per cell) the
    answer is that of ``top_k``: a second scan looks into the further cells
    that may hold a vector as near as a question's last hit so far."""
    match = match or {}
    names = list(match)
    q = written(_questions(questions, k, match, threshold, centroids.shape[1]), "asked")
    kind = q.schema["question_id"].dataType
    near = _nearest_cells(centroids, nprobe)
    asked = _ask(q)
    rows = _probed(q, _pushed(q, indexed, names), near, len(centroids))
    found = _hits(rows, asked, kind, names, near)
    if reach is None:
        return _rank_own(found, asked.largest)
    found = written(found, "near-hits")
    lowest, zeros = np.full(len(centroids), 2.0), np.zeros(len(centroids))
    for r in reach.collect():
        lowest[r["cell"]], zeros[r["cell"]] = r["lowest"], r["zeros"]
    empty = lowest > 1  # nothing is there to be found
    lowest[empty] = 1.0
    ranked = _rank_own(found.withColumn("_threshold", F.lit(None).cast("double")), asked.largest)
    last = ranked.groupBy("question_id").agg(F.count("*").alias("_hits"), F.min("score").alias("_last"))
    floor = F.when(F.col("_hits") >= F.col("_k"), F.col("_last")).otherwise(F.lit(float("-inf")))
    q = written(q.join(last, "question_id", "left").withColumn("_floor", floor).drop("_hits", "_last"), "asked-further")
    further = _further_cells(centroids, nprobe, lowest, zeros)
    probe = lambda block, wanted: further(block, wanted) & ~empty[:, None]
    rows = _probed(q, _pushed(q, indexed, names), probe, len(centroids))
    more = _hits(rows, _ask(q), kind, names, probe)
    return _rank_own(found.unionByName(more), asked.largest)
