"""Response cache as a table: cache_key, query, response (JSON),
source_documents, created_at, expires_at."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmere.functions.joins import skew_join
from quillmere.functions.scalars import cache_key
from quillmere.session import written

TTL_SECONDS = 3600


def with_key(requests: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
    return requests.withColumn("cache_key", cache_key(F.col("query"), *[F.col(p) for p in parts]))


def _live(cache: DataFrame, as_of) -> DataFrame:
    return cache.filter(F.col("expires_at") > F.lit(as_of).cast("timestamp_ntz"))


def lookup(requests: DataFrame, cache: DataFrame, as_of, spread: str) -> tuple[DataFrame, DataFrame]:
    """Hits (with the response) and misses.  ``spread`` names the request id:
    a question asked by a third of all requests is dealt out over it."""
    live = _live(cache, as_of).select("cache_key", "response", "source_documents", F.lit(True).alias("_hit"))
    looked_up = written(skew_join(requests, live, ["cache_key"], "left", spread=[spread]), "cache-lookup")
    hits = looked_up.filter("_hit").drop("_hit")
    misses = looked_up.filter("_hit is null").drop("_hit", "response", "source_documents")
    return hits, misses


def entries(responses: DataFrame, as_of, ttl: int = TTL_SECONDS) -> DataFrame:
    """Cache rows for responses (cache_key, query, response, source_documents);
    of several responses to one key one is kept."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return (
        responses.groupBy("cache_key")
        .agg(F.min(F.struct("query", "response", "source_documents")).alias("_row"))
        .select(
            "cache_key", "_row.*", now.alias("created_at"),
            (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"),
        )
    )


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    return cache.join(fresh.select("cache_key"), "cache_key", "left_anti").unionByName(fresh)


def delete_queries(cache: DataFrame, queries: DataFrame, parts: tuple[str, ...] = ()) -> DataFrame:
    gone = with_key(queries, parts).select("cache_key").distinct()
    return cache.join(gone, "cache_key", "left_anti")


def delete_matching(cache: DataFrame, pattern: str) -> DataFrame:
    """Drop the keys that match a glob (* and ?)."""
    regex = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern)
    return cache.filter(~F.col("cache_key").rlike(f"(?s)^{regex}$"))


def clear(cache: DataFrame) -> DataFrame:
    return cache.limit(0)


def citations(entries_: DataFrame) -> DataFrame:
    """Which document an entry rests on: document_id, cache_key, created_at.
    Kept beside the cache, and for each batch of entries added when they are."""
    return entries_.select(F.explode("source_documents").alias("document_id"), "cache_key", "created_at").distinct()


def append_citations(fresh: DataFrame, path: str, buckets: int = 16) -> None:
    """Add the citations of new entries, in hash buckets of the document."""
    placed = citations(fresh).withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int"))
    placed.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(path)


def read_citations(spark: SparkSession, path: str, documents: DataFrame, buckets: int = 16) -> DataFrame:
    """The citations of the documents' buckets; at most ``buckets`` numbers
    come to the driver."""
    place = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    asked = sorted(documents.agg(F.collect_set(place)).first()[0])
    shape = "document_id string, cache_key string, created_at timestamp_ntz, bucket int"
    return spark.read.schema(shape).parquet(path).filter(F.col("bucket").isin(asked)).drop("bucket")


def invalidate_documents(cache: DataFrame, documents: DataFrame, cited: DataFrame | None = None) -> DataFrame:
    """Drop the answers that rest on any of the documents.  With the kept
    citations no entry is unfolded; one that was replaced since (its
    ``created_at`` is another) is not held to what it cited before."""
    known = citations(cache) if cited is None else cited
    stale = skew_join(
        known, documents.select("document_id").distinct(), ["document_id"], "left_semi", spread=["cache_key"]
    ).select("cache_key", "created_at").distinct()
    return cache.join(stale, ["cache_key", "created_at"], "left_anti").select(cache.columns)


def hit_statistics(looked_up: DataFrame) -> DataFrame:
    """From requests with a boolean ``cached``: hits, misses, hit rate."""
    hits = F.count_if("cached")
    total = F.count("*")
    return looked_up.agg(
        hits.alias("keyspace_hits"),
        (total - hits).alias("keyspace_misses"),
        F.coalesce(F.try_divide(hits * 100.0, total), F.lit(0.0)).alias("hit_rate_percent"),
    )


def answer_with_cache(
    requests: DataFrame,
    cache: DataFrame,
    answer_misses: Callable[[DataFrame], DataFrame],
    as_of,
    request_id: str = "request_id",
    parts: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Answers for all requests and the updated cache.

    ``answer_misses`` gets each missed key once (cache_key, query, ...) and
    returns cache_key, query, response, source_documents.
    """
    keyed = with_key(requests, parts)
    hits, misses = lookup(keyed, cache, as_of, spread=request_id)
    # one whole request a key: the one with the smallest id
    asked = misses.groupBy("cache_key").agg(
        F.min_by(F.struct(*[c for c in misses.columns if c not in ("cache_key", request_id)]), request_id).alias("_r")
    ).select("cache_key", "_r.*")
    fresh = written(entries(answer_misses(asked), as_of), "fresh-answers")
    answered = skew_join(
        misses, fresh.select("cache_key", "response", "source_documents"), ["cache_key"], "inner",
        spread=[request_id],
    )
    answers = hits.withColumn("cached", F.lit(True)).unionByName(answered.withColumn("cached", F.lit(False)))
    return answers, upsert(cache, fresh)
