import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.operators import chunking, embedding


def greedy(text, size, overlap):
    """Word by word: fill, emit, drop words from the front until the rest is
    at most the overlap and leaves room for the next word."""
    pieces, held = [], []
    words = [w if i == 0 else " " + w for i, w in enumerate(text.split(" "))]
    for word in words:
        if sum(map(len, held)) + len(word) > size and held:
            pieces.append("".join(held).strip())
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(word) > size):
                held.pop(0)
        held.append(word)
    pieces.append("".join(held).strip())
    return [p for p in pieces if p]


def one_by_one(text: str, size: int, overlap: int) -> list[str]:
    """One text at a time, piece after piece."""
    words = text.split(" ")
    lengths = np.fromiter((len(w) for w in words), np.int64, len(words))
    lengths[1:] += 1
    out: list[str] = []
    bounds = np.flatnonzero(lengths >= size)
    begin = 0
    for stop in [*bounds.tolist(), len(words)]:
        ends = np.concatenate(([0], np.cumsum(lengths[begin:stop])))
        first, count = 0, stop - begin
        while first < count:
            last = int(np.searchsorted(ends, ends[first] + size, "right")) - 1
            out.append(" ".join(words[begin + first : begin + last]))
            if last == count:
                break
            low = max(ends[last] - overlap, ends[last + 1] - size)
            first = min(int(np.searchsorted(ends, low, "left")), last)
        if stop < len(words):
            long = (" " if stop else "") + words[stop]
            for at in range(0, max(len(long) - overlap, 1), size - overlap):
                out.append(long[at : at + size].strip())
        begin = stop + 1
    return [piece for piece in out if piece]


@pytest.mark.parametrize("seed", range(60))
def test_a_batch_packs_as_its_texts_do(seed):
    rng = random.Random(seed)
    size = rng.choice([2, 3, 10, 25, 60, 1000])
    overlap = rng.randrange(size)
    letters = rng.choice(["x", "xyé", "日本é😀", "x\xa0"])
    make = lambda: " ".join(
        "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 5, 9, size - 1, size, 2 * size + 1])))
        for _ in range(rng.choice([1, 1, 2, 7, 60])))
    texts = [None if rng.random() < 0.1 else "" if rng.random() < 0.1 else make() for _ in range(rng.choice([1, 3, 40]))]
    got = chunking._pack(pa.array(["skipped", *texts], pa.string())[1:], size, overlap).to_pylist()
    assert got == [None if t is None else one_by_one(t, size, overlap) for t in texts]


@pytest.mark.parametrize("seed", range(20))
def test_packing_equals_the_word_by_word_walk(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 25, 60, 1000])
    overlap = rng.randrange(size)
    words = ["x" * rng.randint(1, min(size - 2, 15)) for _ in range(rng.randint(1, 300))]
    text = " ".join(words)
    assert chunking._packed(text, size, overlap) == greedy(text, size, overlap)


def test_a_word_longer_than_a_piece_is_cut():
    pieces = chunking._packed("ab " + "x" * 25 + " cd", 10, 4)
    assert pieces[0] == "ab" and pieces[-1] == "cd"
    assert all(len(p) <= 10 for p in pieces)
    assert "".join(pieces).count("x") >= 25


def test_windows_keep_every_word(spark):
    words = [f"w{i}" for i in range(1000)]
    rows = spark.createDataFrame([("d", " ".join(words)), ("blank", " \n ")], "document_id string, content string")
    for windows in (lambda c: chunking.word_windows(c, 50, 10), lambda c: chunking.packed_windows(c, 100, 20)):
        got = chunking.chunk_documents(rows, windows=windows).orderBy("chunk_index").collect()
        assert {r["document_id"] for r in got} == {"d"}
        assert [r["chunk_index"] for r in got] == list(range(len(got)))
        assert {r["total_chunks"] for r in got} == {len(got)}
        assert got[3]["id"] == "d_chunk_3"
        assert list(dict.fromkeys(w for r in got for w in r["content"].split(" "))) == words


def test_window_overlap_is_exact(spark):
    text = " ".join(f"w{i}" for i in range(130))
    rows = spark.createDataFrame([("d", text)], "document_id string, content string")
    got = chunking.chunk_documents(rows, windows=lambda c: chunking.word_windows(c, 50, 10)).orderBy("chunk_index").collect()
    for a, b in zip(got, got[1:]):
        assert a["content"].split(" ")[-10:] == b["content"].split(" ")[:10]


def test_bad_window():
    with pytest.raises(ValueError):
        chunking.word_windows(F.lit("x"), 10, 10)


def test_texts_are_cut_once(spark):
    """No filter repeats the cleaning below the generator."""
    rows = spark.createDataFrame([("d", "a b")], "document_id string, content string")
    plan = chunking.chunk_documents(rows, windows=chunking.word_windows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(regexp_replace(regexp_replace(") == 1


def test_token_counter_plug_in(spark):
    rows = spark.createDataFrame([("a b c",), (None,)], "t string")
    got = rows.select(chunking.token_counts(F.col("t"), lambda: lambda texts: [len(t.split()) for t in texts])).collect()
    assert [r[0] for r in got] == [3, 0]


def test_only_missing_vectors_are_encoded(spark):
    rows = spark.createDataFrame([("a b", None), ("c", [9.0, 9.0])], "content string, embedding array<float>")

    def load():
        import numpy as np

        def model(texts):
            assert "c" not in texts
            return np.array([[3.0, 4.0] for _ in texts])

        return model

    got = embedding.embed(rows, encoder=embedding.model_encoder(load, batch_size=1)).collect()
    assert got[0]["embedding"] == pytest.approx([0.6, 0.8]) and got[1]["embedding"] == [9.0, 9.0]


def test_hashed_vectors_are_unit(spark):
    rows = spark.createDataFrame([("one two two",), ("...",), (None,)], "content string")
    got = [r["embedding"] for r in embedding.embed(rows).select("embedding").collect()]
    assert len(got[0]) == 384 and sum(x * x for x in got[0]) == pytest.approx(1.0)
    assert sum(got[1]) == 0.0 and got[2] is None
