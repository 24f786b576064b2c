"""Tree concatenation against the tokenizer's own encoding and decoding."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import documents
from hypothesis import given, settings, strategies as st

from quillmere.llm import bpe, held_ids
from quillmere.llm.queries import QUERIES

PATH = bpe.default_tokenizer()
SIGNS = [
    "a", "b", "the", "re", "ll", "s", "t", "'", "'s", "'re", " ", " ", "  ", "\n", "\t", "\x0b", "\xa0", "　", "1", "23", "٣", "½",
    "!", "...", "-", "é", "é", "ß", "語", "日本", "😀", "👩‍👩‍👧", "​", "<|endoftext|>", "<|end", "oftext|>", "<", "|>", "_", "A", "Z", "͸",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def tree(text, leaf):
    codec = bpe.codec(PATH)
    whole = bpe.Tree(codec)
    bounds = codec.halves(text, leaf)
    assert [b[0] for b in bounds[1:]] == [b[1] for b in bounds[:-1]] and bounds[-1][1] == len(text)
    for begin, end, goes_on in bounds:
        whole.add(codec.part(text[begin:end]), goes_on)
    return whole.whole().tolist(), len(bounds)


@given(st.lists(st.sampled_from(SIGNS), min_size=1, max_size=120).map("".join), st.integers(1, 20))
@settings(max_examples=1500, deadline=None)
def test_parts_join_to_the_whole(tokenizer, text, leaf):
    assert tree(text, leaf)[0] == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=30).map("".join), max_size=12), st.integers(0, 3))
@settings(max_examples=800, deadline=None)
def test_stretches_encode_as_the_whole(tokenizer, texts, skipped):
    codec = bpe.codec(PATH)
    codec.held.limit = 40  # generations change all the time
    ids, starts = codec.encode(pa.array([*["x y"] * skipped, *texts], pa.string())[skipped:])
    got = [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_generations_of_held_ids():
    asked = []

    def encode(words):
        asked.append(list(words))
        back = words[::-1]
        return back, np.array([ord(c) for w in back for c in w], np.uint32), np.array([len(w) for w in back], np.int64)

    held = held_ids.HeldIds(encode, limit=4)
    for words in (["a", "bb", "ccc"], ["a", "d", "e"], ["bb", "f"], ["a", "f"], ["ccc"], list("ghijk"), ["bb"], list("lmnop"), ["ccc"]):
        first, sizes = held.spans(words)
        assert ["".join(map(chr, held.flat[x : x + n])) for x, n in zip(first, sizes)] == words
    assert asked == [["a", "bb", "ccc"], ["d", "e"], ["bb", "f"], ["ccc"], list("ghijk"), ["bb"], list("lmnop"), ["ccc"]]
    assert len(held.new.index) + len(held.old.index) <= 4 + 5


@pytest.mark.parametrize(
    "unit", ["a", "ab", "the", "'", "''s", "'re", " ", "\n", " \n", "1", "!", "!'", "語", "é", "😀", "<|endoftext|>", "a<|endoftext|>", " <|endoftext|>", "aAbB", "ing", "-=", "x "]
)
def test_unsplit_runs(tokenizer, unit):
    text = unit * 700 + "end"
    got, parts = tree(text, 50)
    assert parts >= 16 and got == tokenizer.encode(text, add_special_tokens=False).ids


def test_long_random_runs(tokenizer):
    rng = random.Random(5)
    for letters in ("ab", "abcdefghijklmnop", "the ", "日本語の", "0123456789", ".-_=+", " \n\t"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        got, parts = tree(text, 300)
        assert parts >= 64 and got == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.integers(0, 50_300), max_size=40))
@settings(max_examples=200, deadline=None)
def test_decoding(tokenizer, ids):
    got = bpe.codec(PATH).decode(np.array(ids, np.uint32)).decode("utf-8", "replace")
    wanted = tokenizer.decode(ids, skip_special_tokens=False)
    assert got == wanted
    rows = pa.array([np.array(x, "<u4").tobytes() for x in ([], ids, [64, 65], ids)], pa.binary())
    assert bpe.codec(PATH).texts(rows).to_pylist() == ["", wanted, tokenizer.decode([64, 65]), wanted]


def test_encoding_cases(spark, tokenizer):
    long = "".join(f"word{i} " if i % 3 else f"unbroken{i}" for i in range(9_000)) + "x" * 60_000
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "two words"), (None, None), (5, long), (5, long),
        (None, long), (6, "<|endoftext|>" + long[5:]), (7, "a" * 65_537),
    ]
    encoded = bpe.encode(documents(spark, rows))
    assert encoded.columns == ["doc_id", "token_ids"]
    got = bpe.decode(encoded).collect()
    key = lambda r: (r[0] is None, r[0], hashlib.sha256(r[1].encode()).hexdigest())
    wanted = sorted(((d, t or "") for d, t in rows), key=lambda r: key((r[0] or 0 if r[0] is not None else None, r[1])))
    found = sorted(((r["doc_id"], r["text"], r["token_ids"]) for r in got), key=lambda r: key((r[0], r[1])))
    assert [f[:2] for f in found] == wanted
    for _, text, ids in found:
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    empty = bpe.encode(documents(spark, []).limit(0))
    assert empty.count() == 0 == bpe.decode(empty).count()


def test_query_against_the_tokenizer(spark, duck, sf_dir, tokenizer):
    rows = duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op11_bpe_tree_concatenation"](spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert got[doc]["n_tokens"] == len(ids)
        assert got[doc]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[doc]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
