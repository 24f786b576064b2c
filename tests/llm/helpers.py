"""Plain versions of what the operators compute, for small tables."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("_k0", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("sequence_id", T.StringType()),
])


def documents(spark, rows):
    """Documents of (doc_id, text) with further columns whose names the operators also use inside."""
    data = [(d, t, None, f"k{i}", i, None) for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, DOCS).repartition(3)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text, size):
    w = words(lower(text))
    if not w:
        return set()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def linked_components(texts, size, percent):
    """Label of each text: the first text of its component."""
    sets = [shingles(t, size) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(texts))]


def term(word):
    return re.sub(r"^[\W_]+|[\W_]+$", "", word).lower()


def terms(text):
    return [t for t in map(term, words(text)) if t]
