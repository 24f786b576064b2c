"""Unit vectors for texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quillmere.functions.text import WORD

DIMENSION = 384
COUNTED_CELLS = 1 << 19  # counts made at once


def term_buckets(text: Column, dimension: int = DIMENSION) -> Column:
    """Bucket number of every term occurrence, hashed on the JVM side."""
    terms = F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]+"), F.lit(0))
    return F.transform(terms, lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(dimension)).cast("int"))


def hashed_encoder(dimension: int = DIMENSION) -> Callable[[Column], Column]:
    """Default encoder: hashed term counts scaled to unit length.

    The JVM hashes; one vectorised count per ``COUNTED_CELLS`` makes the vectors.
    """
    step = max(1, COUNTED_CELLS // dimension)

    @F.arrow_udf("array<float>")
    def count(buckets: pa.Array) -> pa.Array:
        return pa.concat_arrays([count_some(buckets.slice(at, step)) for at in range(0, max(len(buckets), 1), step)])

    def count_some(buckets: pa.Array) -> pa.Array:
        sizes = pa.compute.list_value_length(buckets).fill_null(0).to_numpy(zero_copy_only=False)
        rows = len(sizes)
        flat = buckets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.repeat(np.arange(rows, dtype=np.int64), sizes) * dimension + flat
        counts = np.bincount(cells, minlength=rows * dimension).reshape(rows, dimension)
        norms = np.sqrt((counts * counts).sum(axis=1, dtype=np.float64))
        unit = (counts / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)
        offsets = np.arange(0, (rows + 1) * dimension, dimension, dtype=np.int32)
        missing = pa.compute.is_null(buckets)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit.ravel()), mask=missing)

    return lambda text: count(term_buckets(text, dimension))


def model_encoder(
    load_model: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32
) -> Callable[[Column], Column]:
    """Encoder around a plug-in model: loaded once per task, fed in batches of
    ``batch_size``, vectors scaled to unit length."""

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load_model()
        for texts in batches:
            out = pd.Series([None] * len(texts), dtype=object)
            wanted = np.flatnonzero(texts.notna().to_numpy())
            for at in range(0, len(wanted), batch_size):
                part = wanted[at : at + batch_size]
                vectors = np.asarray(model(texts.iloc[part].tolist()), dtype=np.float64)
                norms = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = (vectors / np.where(norms > 0, norms, 1.0)).astype(np.float32)
                for row, vector in zip(part, unit):
                    out.iat[row] = vector
            yield out

    return encode


def isolating_encoder(
    load_model: Callable[[], Callable[[list[str]], np.ndarray]], batch_size: int = 32
) -> Callable[[Column], Column]:
    """As ``model_encoder``, for models that may refuse a text: gives a struct
    of ``vector`` and ``error``.  A batch that fails is halved until single
    texts fail, so of n texts with one bad one about 2 log n batches are sent
    again; that text's vector is null and its error is what the model raised.
    A model that cannot be loaded fails the task."""

    def halved(model, texts: list[str]) -> list[tuple[np.ndarray | None, str | None]]:
        try:
            found = np.asarray(model(texts), dtype=np.float64)
            if found.ndim != 2 or len(found) != len(texts):
                raise ValueError(f"{len(texts)} texts gave an array of shape {found.shape}")
            return [(v, None) for v in found]
        except Exception as problem:
            if len(texts) == 1:
                return [(None, f"{type(problem).__name__}: {problem}")]
            half = len(texts) // 2
            return halved(model, texts[:half]) + halved(model, texts[half:])

    @F.arrow_udf("struct<vector: array<float>, error: string>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load_model()
        for texts in batches:
            all_texts = texts.to_pylist()
            vectors, errors = [None] * len(all_texts), [None] * len(all_texts)
            there = [k for k, t in enumerate(all_texts) if t is not None]
            for at in range(0, len(there), batch_size):
                part = there[at : at + batch_size]
                for k, (vector, error) in zip(part, halved(model, [all_texts[k] for k in part])):
                    if vector is not None:
                        norm = np.linalg.norm(vector)
                        vectors[k] = (vector / (norm if norm > 0 else 1.0)).astype(np.float32)
                    errors[k] = error
            yield pa.StructArray.from_arrays(
                [pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], ["vector", "error"])

    return encode


def embed(
    df: DataFrame,
    text_col: str = "content",
    vector_col: str = "embedding",
    encoder: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add vectors; rows that already have one keep it and skip the encoder.
    An isolating encoder also adds ``encode_error``."""
    encode = encoder or hashed_encoder()
    there = F.col(vector_col) if vector_col in df.columns else F.lit(None).cast("array<float>")
    missing = F.when(there.isNull(), F.col(text_col)) if vector_col in df.columns else F.col(text_col)
    coded = df.withColumn("_encoded", encode(missing))
    if isinstance(coded.schema["_encoded"].dataType, T.StructType):
        coded = coded.withColumns({
            vector_col: F.coalesce(there, F.col("_encoded.vector")), "encode_error": F.col("_encoded.error")})
        return coded.drop("_encoded")
    vector = F.coalesce(there, F.col("_encoded")) if vector_col in df.columns else F.col("_encoded")
    return coded.withColumn(vector_col, vector).drop("_encoded")


def dimension_rejects(df: DataFrame, dimension: int, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has another length than the configured one."""
    size = F.coalesce(F.size(vector_col), F.lit(-1))
    return df.filter(size != dimension).withColumn("dimension", size)
