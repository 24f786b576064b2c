"""Documents to overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from quillmere.functions import text as tx
from quillmere.functions.scalars import let


PACKED_BYTES = 4 << 20


def check_window(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the chunk size")


def word_windows(cleaned: Column, size: int = 200, overlap: int = 40) -> Column:
    """Array of windows of ``size`` words that share ``overlap`` words."""
    check_window(size, overlap)
    step = size - overlap

    def cut(words: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(words) - F.lit(size)) / F.lit(step))).cast("int")
        return F.transform(
            F.when(F.element_at(words, 1) != "", F.sequence(F.lit(0), last)).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.array_join(F.slice(words, i * F.lit(step) + 1, F.lit(size)), " "),
        )

    return let(F.split(cleaned, " "), cut)


class _Words(NamedTuple):
    """The words of a batch of texts, parted by single spaces."""

    data: np.ndarray  # the texts' bytes
    begin: np.ndarray  # first byte of each word
    end: np.ndarray
    length: np.ndarray  # code points, with the space before all but a text's first word
    first: np.ndarray  # first word of each text, and the number of words


def _words(texts: pa.Array) -> _Words:
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.empty(0, np.uint8)
    offsets -= offsets[0]
    spaces = np.flatnonzero(data == 0x20)
    before = np.searchsorted(spaces, offsets)
    first = before + np.arange(len(offsets))  # one word more than spaces in each text
    begin, end = (np.empty(first[-1], np.int64) for _ in range(2))
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    begin[opens], begin[~opens] = offsets[:-1], spaces + 1
    closes = np.roll(opens, -1)
    end[closes], end[~closes] = offsets[1:], spaces
    further = np.flatnonzero((data & 0xC0) == 0x80)  # bytes of a sign behind its first
    length = end - begin - np.diff(np.searchsorted(further, np.append(begin, len(data)))) + ~opens
    return _Words(data, begin, end, length, first)


def _reached(begins: np.ndarray, following: np.ndarray) -> np.ndarray:
    """All places on the ways from ``begins``, by doubling the steps; a way
    ends where ``following`` is its own length."""
    seen = np.zeros(len(following) + 1, bool)
    jump, seen[begins], here = np.append(following, len(following)), True, begins
    while True:
        further = jump[here]
        further = further[further < len(following)]
        if not len(further):
            return np.flatnonzero(seen[:-1])
        seen[further] = True
        here, jump = np.concatenate((here, further)), jump[jump]


def _pack(texts: pa.Array, size: int, overlap: int) -> pa.Array:
    """Greedy packing of whole words into at most ``size`` characters; the
    next piece starts at the first word that leaves at most ``overlap``
    characters in common.  A word that alone fills a piece is cut by
    characters.  For every word of the batch one search finds where a piece
    that starts there ends and where the next one starts."""
    words = _words(texts)
    count = len(words.begin)
    total = np.concatenate(([0], np.cumsum(words.length)))
    long = np.flatnonzero(words.length >= size)
    # stretches between long words and text bounds
    bounds = np.unique(np.concatenate((words.first, long, long + 1)))
    stop = np.repeat(bounds[1:], np.diff(bounds))
    last = np.minimum(np.searchsorted(total, total[:-1] + size, "right") - 1, stop)
    more = last < stop
    low = np.maximum(total[last] - overlap, total[np.minimum(last + 1, count)] - size)
    following = np.where(more, np.minimum(np.searchsorted(total, low, "left"), last), count)
    begins = np.setdiff1d(bounds[bounds < count], long)
    place = _reached(begins, following) if len(begins) else begins
    place = place[(words.end[last[place] - 1] > words.begin[place])] if len(place) else place
    first, sizes = words.begin[place], words.end[last[place] - 1] - words.begin[place]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    whole = memoryview(words.data)
    data = b"".join([whole[a : a + n] for a, n in zip(first.tolist(), sizes.tolist())])
    pieces = pa.StringArray.from_buffers(len(place), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))
    if len(long):
        cut, at_word = [], []
        opening = set(words.first.tolist())
        for k in long.tolist():
            text = words.data[words.begin[k] : words.end[k]].tobytes().decode()
            text = text if k in opening else " " + text
            some = [text[at : at + size].strip() for at in range(0, max(len(text) - overlap, 1), size - overlap)]
            cut += [x for x in some if x]
            at_word += [k] * (len(cut) - len(at_word))
        place = np.concatenate((place, np.array(at_word, np.int64)))
        order = np.argsort(place, kind="stable")
        pieces, place = pa.concat_arrays([pieces, pa.array(cut, pa.string())]).take(pa.array(order)), place[order]
    offsets = pa.array(np.searchsorted(place, words.first), pa.int32())
    return pa.ListArray.from_arrays(offsets, pieces, mask=texts.is_null())


def _packed(text: str, size: int, overlap: int) -> list[str]:
    return _pack(pa.array([text], pa.string()), size, overlap)[0].as_py()


def packed_windows(cleaned: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of character-bounded pieces, packed for ``PACKED_BYTES`` of texts
    at a time."""
    check_window(size, overlap)

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // PACKED_BYTES
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        return pa.concat_arrays([_pack(texts[a:b], size, overlap) for a, b in zip(bounds, bounds[1:])])

    return pack(cleaned)


def chunk_documents(
    documents: DataFrame,
    id_col: str = "document_id",
    text_col: str = "content",
    windows: Callable[[Column], Column] = packed_windows,
    metadata_col: str | None = None,
) -> DataFrame:
    """One row per chunk: id, document_id, chunk_index, content, total_chunks
    and, with ``metadata_col``, the document's metadata map.

    The number of chunks comes from the window array itself, so nothing is
    shuffled.
    """
    carried = [] if metadata_col is None else [F.col(metadata_col).alias("metadata")]
    pieces = documents.select(
        F.col(id_col).cast("string").alias("document_id"),
        *carried,
        windows(tx.clean_text(F.col(text_col))).alias("_pieces"),
    )
    kept = ["metadata"] if carried else []
    counted = pieces.withColumn("total_chunks", F.size("_pieces"))
    # The outer form keeps Catalyst from adding a "size > 0" filter below,
    # which would clean and cut every text a second time.
    return (
        counted.select("document_id", *kept, "total_chunks",
                       F.posexplode_outer("_pieces").alias("chunk_index", "content"))
        .filter(F.col("content").isNotNull())
        .select(
            F.concat_ws("_chunk_", "document_id", F.col("chunk_index").cast("string")).alias("id"),
            "document_id", "chunk_index", "content", "total_chunks", *kept,
        )
    )


def with_chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Merge the chunk's own statistics over its document's metadata."""
    content = F.col("content")
    own: dict[str, Column] = {
        "chunk_index": F.col("chunk_index"),
        "chunk_size": F.char_length(content),
        "chunk_token_count": F.char_length(content),
        **tx.profile(content),
        "total_chunks": F.col("total_chunks"),
    }
    empty = F.create_map().cast("map<string,string>")
    base = F.coalesce("metadata", empty) if "metadata" in chunks.columns else empty
    kept = F.map_filter(base, lambda name, _: ~name.isin(*own))
    pairs = [item for name, value in own.items() for item in (F.lit(name), value.cast("string"))]
    return chunks.withColumn("metadata", F.map_concat(kept, F.create_map(*pairs)))


def token_counts(text: Column, load_counter: Callable[[], Callable[[list[str]], list[int]]]) -> Column:
    """Token lengths by a plug-in tokenizer, loaded once per task."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load_counter()
        for texts in batches:
            yield pd.Series(counter(texts.fillna("").tolist()), dtype="int64")

    return count(text)
