"""Queries over vectors and questions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillmere.operators import answering, embedding, response_cache, search
from quillmere.plans import snippets as sn
from quillmere.plans.registry import query, table
from quillmere.plans.text_queries import window_chunks
from quillmere.session import shared_dir, written

# One question per label: the mean vector of its members.
_LABEL_MEANS = """label_means AS (SELECT label, list(v ORDER BY p) AS q FROM (
  SELECT label, p, round(avg(v), 6) AS v FROM (
    SELECT label, generate_subscripts(embedding, 1) AS p, unnest(embedding)::DOUBLE AS v FROM embeddings)
  GROUP BY label, p) GROUP BY label)"""

_SCORED = f"""{_LABEL_MEANS}, scored AS (SELECT m.label::BIGINT AS question_id, e.vec_id AS vector_id, e.label,
    round(list_cosine_similarity(m.q, e.embedding::DOUBLE[]), 6) AS score
  FROM label_means m CROSS JOIN embeddings e)"""


def _ranked(source: str, k: int) -> str:
    return (
        f"SELECT question_id, vector_id, score, row_number() OVER (PARTITION BY question_id "
        f"ORDER BY score DESC, vector_id) AS rank FROM {source} QUALIFY rank <= {k}"
    )


def vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")


def label_questions(spark, sf):
    """Mean vector per label, rounded so that both engines start equal."""
    spots = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    means = spots.groupBy("label", "p").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    packed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("m"))
    return packed.select(F.col("label").alias("question_id"), F.col("m.v").alias("embedding"))


@query(f"WITH {_SCORED} {_ranked('scored', 10)}")
def cosine_top_k(spark, sf):
    return search.top_k(label_questions(spark, sf), vectors(spark, sf), k=10)


@query(f"WITH {_SCORED} {_ranked('(SELECT * FROM scored WHERE label = (question_id + 1) % 10)', 5)}")
def cosine_top_k_matching(spark, sf):
    """Each question brings its own metadata filter."""
    questions = label_questions(spark, sf).withColumn("wanted", F.pmod(F.col("question_id") + 1, F.lit(10)))
    return search.top_k(questions, vectors(spark, sf), k=5, match={"label": "wanted"})


@query(f"WITH {_SCORED} SELECT * FROM ({_ranked('(SELECT * FROM scored WHERE label <> 3)', 20)}) WHERE score >= 0.3")
def cosine_top_k_threshold(spark, sf):
    """Filter, cut to 20, then the threshold."""
    return search.top_k(
        label_questions(spark, sf), vectors(spark, sf), k=20, threshold=0.3, where=F.col("label") != 3
    )


@query(f"""WITH {_SCORED} SELECT * FROM ({_ranked('scored', 10)})
WHERE rank <= question_id % 10 + 1 AND (question_id % 2 = 1 OR score >= 0.3)""")
def cosine_top_k_per_question(spark, sf):
    """Each question brings its own number of results and threshold."""
    asked = label_questions(spark, sf).withColumns({
        "wanted": (F.col("question_id") % 10 + 1).cast("int"),
        "least": F.when(F.col("question_id") % 2 == 0, F.lit(0.3)),
    })
    return search.top_k(asked, vectors(spark, sf), k="wanted", threshold="least")


@query(f"""WITH {_SCORED}, hits AS (SELECT * FROM ({_ranked('scored', 5)}) WHERE score >= 0.3)
SELECT label::BIGINT AS question_id, coalesce(round(avg(score), 6), 0.0) AS confidence, count(score) AS sources
FROM label_means LEFT JOIN hits ON question_id = label GROUP BY label""")
def search_confidence(spark, sf):
    questions = label_questions(spark, sf)
    hits = search.top_k(questions, vectors(spark, sf), k=5, threshold=0.3)
    means = hits.groupBy("question_id").agg(
        F.round(F.avg("score"), 6).alias("confidence"), F.count("*").alias("sources")
    )
    return questions.select("question_id").join(means, "question_id", "left").fillna(0.0, ["confidence"]).fillna(
        0, ["sources"]
    )


@query("SELECT vec_id AS id, len(embedding) - (label = 3)::INT AS dimension FROM embeddings WHERE label = 3")
def dimension_rejects(spark, sf):
    cut = F.when(F.col("label") == 3, F.slice("embedding", 2, 4096)).otherwise(F.col("embedding"))
    rows = vectors(spark, sf)
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    return embedding.dimension_rejects(rows.withColumn("embedding", cut), width).select("id", "dimension")


@query(f"""WITH {_SCORED},
  near AS (SELECT m.label AS cell, e.vec_id, round(list_cosine_similarity(m.q, e.embedding::DOUBLE[]), 9) AS s
           FROM label_means m CROSS JOIN embeddings e),
  cells AS (SELECT vec_id, cell FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) = 1),
  probes AS (SELECT a.label AS question_id, b.label AS cell FROM label_means a CROSS JOIN label_means b
             QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY list_cosine_similarity(a.q, b.q) DESC, b.label) <= 2)
SELECT question_id, vector_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id) AS rank
FROM (SELECT s.* FROM scored s JOIN cells c ON c.vec_id = s.vector_id JOIN probes USING (question_id, cell))
QUALIFY rank <= 10""")
def cell_search(spark, sf):
    """Search by cells around given centroids, two cells per question."""
    questions = label_questions(spark, sf)
    # one centroid per label
    centers = np.array([r["embedding"] for r in questions.orderBy("question_id").collect()])
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    indexed = search.assign_cells(vectors(spark, sf), centers)
    return search.search_cells(questions, indexed, centers, k=10, nprobe=2)


@query(f"WITH {_SCORED} {_ranked('scored', 10)}")
def cell_search_trained(spark, sf):
    """Cells by k-means, written once with their reach; the nearest cells and
    then those that can still hold a hit make the exact answer."""
    rows = vectors(spark, sf)
    centers = search.train_cells(rows, cells=32, iterations=5, most_rows=10_000)
    path = shared_dir(spark, "cells")
    search.write_cells(search.assign_cells(rows, centers), path)
    indexed = spark.read.parquet(path)
    reach = written(search.cell_reach(indexed, centers), "reach")
    return search.search_cells(label_questions(spark, sf), indexed, centers, k=10, nprobe=20, reach=reach)


_TERM_CTES = f"""chunks AS (SELECT * FROM {sn.DOCUMENT_CHUNKS}),
  asked AS (SELECT item_id, text FROM benchmark),
  {sn.terms(('chunks', 'content'), ('asked', 'text'))}, {sn.TERM_BUCKETS},
  {sn.weights('chunks', 'id', 'content', 'c')}"""


@query(f"""WITH {_TERM_CTES}
SELECT id, coalesce(count(bucket), 0) AS buckets, coalesce(round(sum(w * bucket), 4), 0.0) AS moment,
       coalesce(round(max(w), 6), 0.0) AS peak
FROM chunks LEFT JOIN weights_c USING (id) GROUP BY id""")
def hashed_term_vectors(spark, sf):
    vector = F.transform("embedding", lambda x: x.cast("double"))
    spots = F.transform(vector, lambda x, i: x * i)
    return embedding.embed(window_chunks(spark, sf)).select(
        "id",
        F.size(F.filter(vector, lambda x: x > 0)).alias("buckets"),
        F.round(F.aggregate(spots, F.lit(0.0), lambda a, x: a + x), 4).alias("moment"),
        F.round(F.array_max(vector), 6).alias("peak"),
    )


@query(f"""WITH {_TERM_CTES}, {sn.weights('asked', 'item_id', 'text', 'q')},
  pairs AS (SELECT q.id AS question_id, c.id AS vector_id, sum(q.w * c.w) AS s
            FROM weights_q q JOIN weights_c c USING (bucket) GROUP BY 1, 2),
  scored AS (SELECT item_id AS question_id, c.id AS vector_id, round(coalesce(s, 0.0), 6) AS score
             FROM asked CROSS JOIN chunks c LEFT JOIN pairs ON question_id = item_id AND vector_id = c.id),
  hits AS (SELECT h.*, content FROM (SELECT * FROM ({_ranked('scored', 3)}) WHERE score >= 0.4) h
           JOIN chunks ON id = vector_id),
  found AS (SELECT question_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context,
                   string_agg(vector_id, ',' ORDER BY rank) AS sources, avg(score) AS confidence, count(*) AS n
            FROM hits GROUP BY question_id)
SELECT item_id AS question_id, {sn.answer('text', 'context')} AS answer, coalesce(sources, '') AS sources,
       round(coalesce(confidence, 0.0), 6) AS confidence_score, coalesce(n, 0) AS num_sources
FROM asked LEFT JOIN found ON question_id = item_id""")
def answer_questions(spark, sf):
    """Benchmark passages as questions over the document chunks."""
    chunks = embedding.embed(window_chunks(spark, sf))
    questions = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("question_id"), F.col("text").alias("query")
    )
    answers = answering.answer_questions(questions, chunks, k=3, threshold=0.4)
    return answers.select(
        "question_id", "answer", F.array_join("source_ids", ",").alias("sources"),
        F.round("confidence_score", 6).alias("confidence_score"), "num_sources",
    )


@query(f"""WITH {_TERM_CTES}, {sn.weights('asked', 'item_id', 'text', 'q')},
  pairs AS (SELECT q.id AS question_id, c.id AS vector_id, sum(q.w * c.w) AS s
            FROM weights_q q JOIN weights_c c USING (bucket) GROUP BY 1, 2),
  scored AS (SELECT item_id AS question_id, c.id AS vector_id, round(coalesce(s, 0.0), 6) AS score
             FROM asked CROSS JOIN chunks c LEFT JOIN pairs ON question_id = item_id AND vector_id = c.id),
  hits AS (SELECT h.*, content FROM ({_ranked('scored', 3)}) h JOIN chunks ON id = vector_id
           WHERE rank <= 1 + question_id % 3 AND score >= CASE WHEN question_id % 2 = 0 THEN 0.3 ELSE 0.5 END),
  found AS (SELECT question_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context,
                   count(*) AS n
            FROM hits GROUP BY question_id),
  answered AS (SELECT item_id, item_id || '-' || r AS request_id, item_id % 5 = 0 AS cached,
      CASE WHEN item_id % 5 = 0 THEN 'known' ELSE {sn.answer('text', 'context')} END AS answer,
      CASE WHEN item_id % 5 = 0 THEN 0 ELSE coalesce(n, 0) END AS num_sources
    FROM asked CROSS JOIN (SELECT unnest([0, 1]) AS r) LEFT JOIN found ON question_id = item_id)
SELECT request_id, cached, answer, num_sources, rank, vector_id, round(score, 4) AS score
FROM answered LEFT JOIN hits ON question_id = item_id AND NOT cached""")
def answer_requests(spark, sf):
    """Each benchmark passage asked twice, a fifth of them cached, every request
    with its own number of results and threshold; a row for each source."""
    item = F.col("item_id")
    requests = table(spark, sf, "benchmark").select(
        F.explode(F.array(F.concat(item.cast("string"), F.lit("-0")), F.concat(item.cast("string"), F.lit("-1")))).alias("request_id"),
        "item_id", F.col("text").alias("query"), (item % 3 + 1).cast("int").alias("max_results"),
        F.when(item % 2 == 0, F.lit(0.3)).otherwise(F.lit(0.5)).alias("similarity_threshold"),
    )
    parts = ("max_results", "similarity_threshold")
    now = F.lit(sn.AS_OF).cast("timestamp_ntz")
    known = answering.validate_requests(requests.filter(item % 5 == 0))
    cache = response_cache.with_key(known, parts).select(
        "cache_key", "query", F.lit('{"answer":"known","num_sources":0,"sources":[]}').alias("response"),
        F.array().cast("array<string>").alias("source_documents"), now.alias("created_at"),
        (now + F.make_dt_interval(hours=F.lit(1))).alias("expires_at"),
    ).distinct()
    chunks = embedding.embed(window_chunks(spark, sf))
    answers, _, _ = answering.answer_requests(requests.drop("item_id"), chunks, cache, sn.AS_OF)
    shape = "answer string, num_sources long, sources array<struct<vector_id: string, score: double>>"
    read = answers.select("request_id", "cached", F.from_json("response", shape).alias("r"))
    sources = read.select(
        "request_id", "cached", "r.answer", "r.num_sources", F.posexplode_outer("r.sources").alias("place", "source"))
    return sources.select(
        "request_id", "cached", "answer", "num_sources", (F.col("place") + 1).cast("long").alias("rank"),
        # the search divides by the length of the stored floats, the check does not: they differ in the eighth digit
        "source.vector_id", F.round("source.score", 4).alias("score"),
    )


@query(f"""SELECT conv_id, turn, query, max_results, similarity_threshold, error, error IS NULL AS valid FROM (
  SELECT conv_id, turn, {sn.strip('text')} AS query, coalesce(r, 5) AS max_results, t AS similarity_threshold,
    CASE WHEN length(text) < 1 OR {sn.strip('text')} = '' THEN 'Query cannot be empty'
         WHEN length(text) > 1000 THEN 'Query is too long'
         WHEN coalesce(r, 5) NOT BETWEEN 1 AND 20 THEN 'max_results out of range'
         WHEN t NOT BETWEEN 0.0 AND 1.0 THEN 'similarity_threshold out of range' END AS error
  FROM (SELECT *, CASE WHEN role <> 'user' THEN turn * 6 END AS r, length(text) / 400.0 AS t FROM conversations))""")
def request_validation(spark, sf):
    requests = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.col("text").alias("query"),
        F.when(F.col("role") != "user", F.col("turn") * 6).alias("max_results"),
        (F.char_length("text") / 400.0).alias("similarity_threshold"),
    )
    return answering.validate_requests(requests)
