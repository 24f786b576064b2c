"""Queries that clean, gate, maintain and curate tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from quillmere.operators import analytics, chunk_store, cleaning, curation, ingestion, lake, quality, response_cache
from quillmere.operators.chunking import word_windows
from quillmere.plans import lake_etl, snippets as sn
from quillmere.plans.log_queries import query_logs
from quillmere.plans.registry import entries, query, stamp, table, texts
from quillmere.plans.text_queries import window_chunks
from quillmere.schemas import QUERY_LOGS
from quillmere.session import shared_dir, written
from quillmere.sources import collections, jdbc, rest
from quillmere.sources.registry import read_source

AS_OF = sn.AS_OF


def dirty_events(spark, sf) -> DataFrame:
    """Events with holes, untidy text and repeated rows."""
    kind = F.concat(F.lit("\t "), F.upper("event_type"), F.lit(" "))
    rows = table(spark, sf, "events").select(
        "event_id", "user_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"), "event_type"
    )
    first = rows.withColumn("event_type", F.when(F.col("event_type") != "click", kind))
    again = rows.filter(F.col("event_type") == "error").withColumn("event_type", kind)
    return first.unionByName(again)


@query(f"SELECT DISTINCT * FROM {sn.DIRTY_EVENTS}")
def drop_duplicate_rows(spark, sf):
    return cleaning.drop_duplicate_rows(dirty_events(spark, sf))


@query(f"""WITH d AS (SELECT DISTINCT * FROM {sn.DIRTY_EVENTS})
SELECT event_id, user_id, coalesce(value, (SELECT median(value) FROM d)) AS value,
  {sn.strip("lower(coalesce(event_type, ''))")} AS event_type, '2024-01-30T12:00:00' AS processed_at FROM d""")
def process_table(spark, sf):
    return cleaning.process_table(dirty_events(spark, sf), "2024-01-30T12:00:00")


def _profile_sql(name: str, source: str, cells: list[str]) -> str:
    nulls = " + ".join(f"({c} IS NULL)::INT" for c in cells)
    return f"""SELECT '{name}' AS asset, count(*) AS row_count, {len(cells)}::BIGINT AS column_count,
      round(sum({nulls}) * 100.0 / (count(*) * {len(cells)}), 6)::DOUBLE AS null_percentage,
      count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS duplicate_rows FROM {source}"""


_PROFILES = " UNION ALL ".join([
    _profile_sql("events", sn.DIRTY_EVENTS, ["event_id", "user_id", "value", "event_type"]),
    _profile_sql("customer", "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]),
    _profile_sql("documents", "(SELECT text, lang FROM documents)", ["text", "lang"]),
])


def _profiles(spark, sf) -> DataFrame:
    return quality.profile_tables(
        {
            "events": dirty_events(spark, sf),
            "customer": table(spark, sf, "customer"),
            "documents": table(spark, sf, "documents").select("text", "lang"),
        }
    )


@query(_PROFILES)
def table_profiles(spark, sf):
    return _profiles(spark, sf).withColumn("null_percentage", F.round("null_percentage", 6))


@query(f"""SELECT asset, round(duplicate_rows * 100.0 / row_count, 6)::DOUBLE AS duplicate_percentage,
  null_percentage <= 20 AND duplicate_rows * 100.0 / row_count <= 5 AS passed FROM ({_PROFILES})""")
def table_quality_gate(spark, sf):
    return quality.gate_tables(_profiles(spark, sf)).select(
        "asset", F.round("duplicate_percentage", 6).alias("duplicate_percentage"), "passed"
    )


_ROW_ERROR = """CASE WHEN text IS NULL OR text = '' THEN 'missing content' WHEN lang = 'de' THEN 'missing title'
  WHEN length(text) < 100 THEN 'too short' WHEN length(text) > 1000000 THEN 'too long' END"""


def _gated_documents(spark, sf) -> DataFrame:
    documents = table(spark, sf, "documents").select(
        "doc_id", "source", F.col("text").alias("content"), F.when(F.col("lang") != "de", F.col("source")).alias("title")
    )
    return quality.gate_rows(documents)


@query(f"""SELECT doc_id, e AS quality_error, e IS NULL AS quality_ok
FROM (SELECT doc_id, {_ROW_ERROR} AS e FROM documents)""")
def row_quality_gate(spark, sf):
    return _gated_documents(spark, sf).select("doc_id", "quality_error", "quality_ok")


@query(f"""SELECT source, count(*) AS checked, count(*) FILTER (e IS NULL) AS passed,
  round(avg((e IS NULL)::INT) * 100, 6) AS pass_rate_percent
FROM (SELECT source, {_ROW_ERROR} AS e FROM documents) GROUP BY source""")
def quality_pass_rate(spark, sf):
    return lake.pass_rate(_gated_documents(spark, sf)).withColumn(
        "pass_rate_percent", F.round("pass_rate_percent", 6)
    )


@query("""SELECT doc_id, CASE WHEN octet_length(encode(text)) NOT BETWEEN 100 AND 100000000 THEN 'file size'
  WHEN lang = 'es' THEN 'extension' WHEN length(text) < 50 THEN 'content length'
  WHEN lang = 'fr' THEN 'metadata upload_date' END AS quality_error FROM documents""")
def file_quality_gate(spark, sf):
    suffix = F.when(F.col("lang") == "es", ".exe").otherwise(".md")
    given = F.when(F.col("lang") == "fr", F.create_map(F.lit("source"), "source")).otherwise(
        F.create_map(F.lit("source"), F.col("source"), F.lit("upload_date"), F.lit("2024-01-01"))
    )
    files = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("source"), suffix).alias("file_path"), F.octet_length("text").alias("file_size"),
        F.col("text").alias("content"), given.alias("metadata"),
    )
    return quality.gate_files(files).select("doc_id", "quality_error")


# ---- catalog ----


def assets(spark, sf) -> DataFrame:
    lang = F.col("lang")
    created = F.lit("2023-06-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("n_chars") * 37).cast("int"))
    return table(spark, sf, "documents").select(
        F.when(lang == "en", "raw").when(lang == "de", "processed").when(lang == "es", "curated")
        .otherwise("documents").alias("zone"),
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"),
        F.when(F.col("n_chars") > 2000, "parquet").otherwise("text").alias("format"),
        F.octet_length("text").alias("size_bytes"),
        created.alias("created_at"),
        F.array("lang", "source").alias("tags"),
        "source",
    )


def _keys(df: DataFrame) -> DataFrame:
    return df.select("zone", "key", "size_bytes")


@query(f"""WITH a AS (SELECT * FROM {sn.ASSETS}),
  f AS (SELECT zone, string_agg(format || '=' || n, ';' ORDER BY format || '=' || n) AS formats
        FROM (SELECT zone, format, count(*) AS n FROM a GROUP BY ALL) GROUP BY zone),
  s AS (SELECT zone, string_agg(source || '=' || n, ';' ORDER BY source || '=' || n) AS sources
        FROM (SELECT zone, source, count(*) AS n FROM a GROUP BY ALL) GROUP BY zone)
SELECT zone, count(*) AS total_assets, sum(size_bytes)::BIGINT AS total_size_bytes,
  round_even(sum(size_bytes) / 1048576.0, 2)::DOUBLE AS total_size_mb, any_value(formats) AS formats, any_value(sources) AS sources
FROM a JOIN f USING (zone) JOIN s USING (zone) GROUP BY zone""")
def zone_statistics(spark, sf):
    stats = lake.zone_statistics(assets(spark, sf))
    return stats.withColumns({c: entries(F.col(c)) for c in ("formats", "sources")})


@query(f"""SELECT zone, key, size_bytes FROM {sn.ASSETS}
WHERE zone = 'raw' AND starts_with(key, 'src1') AND list_has_any(tags, ['src1', 'src12', 'none'])""")
def list_assets(spark, sf):
    return _keys(lake.list_assets(assets(spark, sf), "raw", "src1", ["src1", "src12", "none"]))


@query(f"""SELECT zone, key, size_bytes FROM {sn.ASSETS} WHERE key NOT IN
  (SELECT source || '/' || d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE toxic = 1)""")
def delete_assets(spark, sf):
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("_id"))
    catalog = assets(spark, sf)
    gone = catalog.join(toxic, F.element_at(F.split("key", "/"), -1) == F.col("_id"), "left_semi")
    return _keys(lake.delete_assets(catalog, gone))


@query(f"""SELECT zone, key, size_bytes FROM {sn.ASSETS} WHERE zone = 'documents' OR created_at >= {sn.NOW} -
  INTERVAL 1 DAY * CASE zone WHEN 'raw' THEN 90 WHEN 'processed' THEN 180 ELSE 365 END""")
def expire_assets(spark, sf):
    return _keys(lake.expire_assets(assets(spark, sf), AS_OF))


@query(f"SELECT zone, key, size_bytes FROM {sn.ASSETS} WHERE created_at::DATE = DATE '2023-07-01'")
def assets_created_on(spark, sf):
    return _keys(quality.created_on(assets(spark, sf), "2023-07-01"))


@query(f"""SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS hour, source, count(*) AS files
FROM {sn.ASSETS} GROUP BY ALL""")
def ingestion_rate(spark, sf):
    return lake.ingestion_rate(assets(spark, sf)).withColumn("hour", stamp(F.col("hour")))


@query(f"""SELECT a.key, date_diff('second', min(a.created_at), min(a.created_at + INTERVAL 1 SECOND * (60 + size_bytes))) AS latency_seconds
FROM {sn.ASSETS} a WHERE zone = 'raw' GROUP BY a.key""")
def curation_latency(spark, sf):
    raw = lake.list_assets(assets(spark, sf), zone="raw")
    later = F.col("created_at") + F.make_dt_interval(secs=F.lit(60) + F.col("size_bytes"))
    curated = raw.withColumns({"zone": F.lit("curated"), "created_at": later})
    return lake.curation_latency(raw.unionByName(curated)).select("key", "latency_seconds")


@query("""SELECT z.zone, p.key, p.format, 'labels' AS first_tag, n FROM (SELECT unnest(['raw', 'processed']) AS zone) z,
  (SELECT 'daily/labels' AS key, 'parquet' AS format) p,
  (SELECT count(*) AS n FROM labels)
UNION ALL SELECT 'curated', 'daily/labels', 'parquet', 'labels', count(*) FROM labels WHERE quality = 1""")
def lake_round_trip(spark, sf):
    """Land, promote twice, list the catalog and read every asset back."""
    root, now = shared_dir(spark, "lake"), datetime(2024, 1, 30, 12)
    lake.store(table(spark, sf, "labels"), root, "raw", "daily/labels", now, tags=["labels"], source="labels")
    lake.promote(spark, root, "raw", "processed", "daily/labels", "parquet", now)
    lake.promote(spark, root, "processed", "curated", "daily/labels", "parquet", now, lambda df: df.filter("quality = 1"))
    counts = jdbc.union_sources([
        lake.load(spark, root, z, "daily/labels", "parquet").agg(F.lit(z).alias("zone"), F.count("*").alias("n"))
        for z in ("raw", "processed", "curated")
    ])
    listed = lake.list_assets(lake.catalog(spark, root), prefix="daily/").filter("size_bytes > 0")
    return listed.join(counts, "zone").select("zone", "key", "format", F.lit("labels").alias("first_tag"), "n")


# ---- joins and maintenance ----

_CHUNK_COUNTS = f"(SELECT document_id AS id, count(*) AS n FROM {sn.DOCUMENT_CHUNKS} GROUP BY 1)"


@query(f"""SELECT d.id, source, status, coalesce(n, 0) AS actual_chunk_count FROM {sn.STORED} d LEFT JOIN {_CHUNK_COUNTS} c USING (id)""")
def document_summary(spark, sf):
    documents = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"), "source",
        F.when(F.col("n_chars") >= 100, "completed").otherwise("pending").alias("status"),
    )
    return ingestion.document_summary(documents, window_chunks(spark, sf))


@query(f"""SELECT count(*) AS total_entities, count(DISTINCT document_id) AS total_documents,
  sum(octet_length(encode(content)))::BIGINT AS total_size_bytes FROM {sn.DOCUMENT_CHUNKS}""")
def collection_stats(spark, sf):
    return chunk_store.collection_stats(window_chunks(spark, sf))


def _toxic(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))


@query(f"""SELECT id, document_id, chunk_index FROM {sn.DOCUMENT_CHUNKS}
WHERE document_id NOT IN (SELECT doc_id::VARCHAR FROM labels WHERE toxic = 1)""")
def cascade_delete(spark, sf):
    return ingestion.cascade_delete(window_chunks(spark, sf), _toxic(spark, sf)).select("id", "document_id", "chunk_index")


@query(f"""SELECT l.id AS document_id, coalesce(n, 0) AS deleted FROM (SELECT DISTINCT doc_id::VARCHAR AS id FROM labels WHERE toxic = 1) l
LEFT JOIN {_CHUNK_COUNTS} c USING (id)""")
def deleted_chunk_counts(spark, sf):
    gone = _toxic(spark, sf).withColumnRenamed("id", "document_id")
    return chunk_store.deleted_counts(window_chunks(spark, sf), gone)


@query(f"""SELECT l.id AS document_id, coalesce(n, 0) AS before, 0::BIGINT AS after FROM
(SELECT DISTINCT doc_id::VARCHAR AS id FROM labels WHERE toxic = 1) l LEFT JOIN {_CHUNK_COUNTS} c USING (id)""")
def stored_chunk_counts(spark, sf):
    """Chunks of documents in the store before and after their removal, read
    from these documents' buckets."""
    store = shared_dir(spark, "counted")
    gone = written(_toxic(spark, sf).withColumnRenamed("id", "document_id"), "gone")
    none = {"embedding": F.lit(None).cast("array<float>"), "metadata": F.create_map().cast("map<string,string>")}
    chunk_store.create(spark, store)
    chunk_store.insert(window_chunks(spark, sf).withColumns(none), store, chunk_store.begin(spark, store, "load"))
    before = written(chunk_store.stored_counts(gone, store).withColumnRenamed("deleted", "before"), "before")
    chunk_store.remove(gone, store, chunk_store.begin(spark, store, "removal"))
    after = chunk_store.stored_counts(gone, store).withColumnRenamed("deleted", "after")
    return before.join(after, "document_id")


@query(f"""SELECT id, CASE WHEN user_id NOT IN (SELECT user_id FROM events WHERE value > 200) THEN user_id::VARCHAR END AS user_id,
  endpoint FROM {sn.LOGS}""")
def forget_users(spark, sf):
    gone = table(spark, sf, "events").filter("value > 200").select("user_id")
    kept = ingestion.forget_users(query_logs(spark, sf), gone)
    return kept.select("id", F.col("user_id").cast("string").alias("user_id"), "endpoint")


@query("""SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels
UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def insert_if_absent(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic"))
    return ingestion.insert_if_absent(table(spark, sf, "labels"), rows, "doc_id")


_VISIBLE = f"""(SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'updated ' || text ELSE text END AS text,
  CASE WHEN lang = 'fr' THEN 'title=new ' || doc_id || ';v=2' ELSE '' END AS metadata
  FROM documents WHERE lang = 'de' OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""


@query(f"SELECT id, content, metadata FROM {sn.window_chunks(_VISIBLE, 'doc_id', 'text', ', metadata')}")
def chunk_store_lifecycle(spark, sf):
    """Insert all, delete some, replace some, change metadata, compact."""
    from quillmere.operators.chunking import chunk_documents

    store, target = shared_dir(spark, "store"), shared_dir(spark, "compacted")
    none = {"embedding": F.lit(None).cast("array<float>"), "metadata": F.create_map().cast("map<string,string>")}
    documents = texts(spark, sf, "documents")
    chunk_store.create(spark, store)
    step = lambda n: chunk_store.begin(spark, store, "load", n)
    chunk_store.insert(window_chunks(spark, sf).withColumns(none), store, step(1))
    chunk_store.remove(_toxic(spark, sf).withColumnRenamed("id", "document_id"), store, step(2))
    german = documents.filter("lang = 'de'").withColumn("text", F.concat(F.lit("updated "), F.col("text")))
    fresh = chunk_documents(german, "doc_id", "text", windows=word_windows).withColumns(none)
    chunk_store.replace(fresh, german.select(F.col("doc_id").cast("string").alias("document_id")), store, step(3))
    french = documents.filter("lang = 'fr'").select(F.col("doc_id").cast("string").alias("document_id"))
    title = F.concat(F.lit("new "), F.col("document_id"))
    first = french.select("document_id", F.create_map(F.lit("title"), F.lit("old"), F.lit("v"), F.lit("2")).alias("metadata"), F.lit("1").alias("sequence"))
    second = french.select("document_id", F.create_map(F.lit("title"), title).alias("metadata"), F.lit("2").alias("sequence"))
    chunk_store.change_metadata(first.unionByName(second), store, step(4))
    chunk_store.compact(spark, store, target)
    return chunk_store.current(spark, target).select("id", "content", entries(F.col("metadata")).alias("metadata"))


# ---- response cache ----

_REQUESTS = """(SELECT conv_id || '-' || turn AS request_id, text AS query FROM conversations WHERE role = 'user')"""
_CACHE = f"""(SELECT 'rag_query:' || md5(text) AS cache_key, text AS query, 'R ' || left(text, 10) AS response,
  {sn.NOW} + INTERVAL 1 MINUTE * (length(text) - 150) AS expires_at, lang FROM (SELECT text, min(conv_id) % 4 AS lang
  FROM conversations WHERE role = 'user' GROUP BY text))"""


def _requests(spark, sf) -> DataFrame:
    asked = table(spark, sf, "conversations").filter("role = 'user'")
    return asked.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("request_id"),
        F.col("text").alias("query"),
    )


def _cache(spark, sf) -> DataFrame:
    """A cache of all questions; short ones are expired."""
    asked = table(spark, sf, "conversations").filter("role = 'user'").groupBy(F.col("text").alias("query")).agg(
        F.pmod(F.min("conv_id"), F.lit(4)).alias("_group")
    )
    now = F.lit(AS_OF).cast("timestamp_ntz")
    minutes = F.char_length("query") - 150
    return response_cache.with_key(asked).select(
        "cache_key", "query", F.concat(F.lit("R "), F.left("query", F.lit(10))).alias("response"),
        F.array(F.concat(F.lit("g"), F.col("_group").cast("string"))).alias("source_documents"),
        now.alias("created_at"), (now + F.make_dt_interval(mins=minutes)).alias("expires_at"),
    )


@query(f"""SELECT request_id, CASE WHEN expires_at > {sn.NOW} THEN response END AS response, expires_at > {sn.NOW} AS cached
FROM {_REQUESTS} JOIN {_CACHE} USING (query)""")
def cache_lookup(spark, sf):
    keyed = response_cache.with_key(_requests(spark, sf))
    hits, misses = response_cache.lookup(keyed, _cache(spark, sf), AS_OF, spread="request_id")
    return hits.select("request_id", "response", F.lit(True).alias("cached")).unionByName(
        misses.select("request_id", F.lit(None).cast("string").alias("response"), F.lit(False).alias("cached"))
    )


@query(f"""SELECT count(*) FILTER (expires_at > {sn.NOW}) AS keyspace_hits, count(*) FILTER (expires_at <= {sn.NOW}) AS keyspace_misses,
  round(avg((expires_at > {sn.NOW})::INT) * 100, 6) AS hit_rate_percent FROM {_REQUESTS} JOIN {_CACHE} USING (query)""")
def cache_statistics(spark, sf):
    return response_cache.hit_statistics(cache_lookup(spark, sf)).withColumn(
        "hit_rate_percent", F.round("hit_rate_percent", 6)
    )


_FRESH = f"""SELECT DISTINCT 'rag_query:' || md5(query) AS cache_key, 'fresh' AS response, '2024-01-30 13:00:00' AS expires_at
  FROM {_REQUESTS} JOIN {_CACHE} USING (query) WHERE expires_at <= {sn.NOW}"""
_OLD = f"""SELECT cache_key, response, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM {_CACHE}"""


def _cache_columns(df: DataFrame) -> DataFrame:
    return df.select("cache_key", "response", stamp(F.col("expires_at")).alias("expires_at"))


def _answer_misses(asked: DataFrame) -> DataFrame:
    return asked.select(
        "cache_key", "query", F.lit("fresh").alias("response"), F.array().cast("array<string>").alias("source_documents")
    )


@query(f"SELECT * FROM ({_FRESH}) UNION ALL SELECT * FROM ({_OLD}) WHERE cache_key NOT IN (SELECT cache_key FROM ({_FRESH}))")
def cache_upsert(spark, sf):
    """The cache after answering its misses."""
    _, cache = response_cache.answer_with_cache(_requests(spark, sf), _cache(spark, sf), _answer_misses, AS_OF)
    return _cache_columns(cache)


@query(f"""SELECT request_id, expires_at > {sn.NOW} AS cached, CASE WHEN expires_at > {sn.NOW} THEN response ELSE 'fresh' END AS response
FROM {_REQUESTS} JOIN {_CACHE} USING (query)""")
def answer_with_cache(spark, sf):
    answers, _ = response_cache.answer_with_cache(_requests(spark, sf), _cache(spark, sf), _answer_misses, AS_OF)
    return answers.select("request_id", "cached", "response")


@query(f"""SELECT md5(request_id || '|{AS_OF}') AS id, query AS query_text, expires_at > {sn.NOW} AS cached, '{AS_OF}' AS created_at
FROM {_REQUESTS} JOIN {_CACHE} USING (query)""")
def query_log_append(spark, sf):
    """Cached and fresh answers logged, hits included."""
    answers, _ = response_cache.answer_with_cache(_requests(spark, sf), _cache(spark, sf), _answer_misses, AS_OF)
    path = shared_dir(spark, "query_logs")
    analytics.append_log(analytics.log_rows(answers, AS_OF), path)
    written_rows = spark.read.schema(QUERY_LOGS).parquet(path)
    return written_rows.select("id", "query_text", "cached", stamp(F.col("created_at")).alias("created_at"))


@query(f"""SELECT * FROM ({_OLD}) WHERE NOT regexp_matches(cache_key, '^rag_query:[0-9a-f]a.*$') AND
  cache_key NOT IN (SELECT 'rag_query:' || md5(text) FROM conversations WHERE role = 'user' AND turn = 0)""")
def cache_delete(spark, sf):
    """Delete by question, then by key pattern."""
    first = table(spark, sf, "conversations").filter("role = 'user' and turn = 0").select(F.col("text").alias("query"))
    left = response_cache.delete_queries(_cache(spark, sf), first)
    return _cache_columns(response_cache.delete_matching(left, "rag_query:?a*"))


@query(f"SELECT cache_key, response, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at FROM {_CACHE} WHERE lang <> 2")
def cache_invalidation(spark, sf):
    """Drop the answers that cite a changed document."""
    gone = spark.createDataFrame([("g2",), ("unknown",)], "document_id string")
    cache, path = _cache(spark, sf), shared_dir(spark, "citations")
    response_cache.append_citations(cache, path)
    cited = response_cache.read_citations(spark, path, gone)
    return _cache_columns(response_cache.invalidate_documents(cache, gone, cited))


# ---- curation and ingestion ----


def _meta_sql(*names: str) -> str:
    return "array_to_string(list_sort([" + ", ".join(f"'{n}=' || {n}" for n in names) + "]), ';')"


_CURATED = f"""(SELECT 'doc_' || doc_id AS document_id, 'text: ' || text AS content, {_meta_sql('doc_id', 'lang', 'n_chars', 'source')} AS metadata
  FROM documents WHERE length(text) > 50)"""


@query(f"SELECT * FROM {_CURATED}")
def curate_rows(spark, sf):
    curated = curation.curate_rows(table(spark, sf, "documents"), "doc_id")
    return curated.select("document_id", "content", entries(F.col("metadata")).alias("metadata"))


@query(f"""SELECT document_id, content AS file_content, document_id || '.txt' AS filename, length(content) AS file_size, 'txt' AS file_type,
  document_id AS title, 'data_lake://curated/documents' AS source_url, 'data_lake,curated' AS tags FROM {_CURATED}""")
def ingestion_requests(spark, sf):
    requests = curation.ingestion_requests(curation.curate_rows(table(spark, sf, "documents"), "doc_id"), "documents")
    return requests.drop("file_url", "process_immediately").withColumn("tags", F.array_join("tags", ","))


def _ingestion_requests(spark, sf) -> DataFrame:
    """Every document as a request; Spanish ones only bring a url."""
    rows = texts(spark, sf, "documents")
    spanish = F.col("lang") == "es"
    return rows.select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.when(~spanish, F.col("text")).alias("file_content"),
        F.when(spanish, F.lit("http://x/")).alias("file_url"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
        F.char_length("text").alias("file_size"),
        F.lit("txt").alias("file_type"),
        F.col("source").alias("title"),
        F.lit(None).cast("string").alias("source_url"),
        F.array("lang").alias("tags"),
        (F.col("lang") != "fr").alias("process_immediately"),
    )


_RESPONSES = f"""(SELECT doc_id::VARCHAR AS document_id,
  CASE WHEN lang = 'es' THEN 'failed' WHEN lang = 'fr' THEN 'pending' ELSE 'completed' END AS status,
  CASE WHEN lang = 'es' THEN 'Failed to ingest document: URL loading not yet implemented'
       ELSE 'Successfully processed document with ' || coalesce(n, 0) || ' chunks' END AS message,
  CASE WHEN lang = 'es' THEN 0 ELSE coalesce(n, 0) END AS chunks_created
FROM documents LEFT JOIN {_CHUNK_COUNTS} c ON c.id = doc_id::VARCHAR)"""


def _responses(spark, sf) -> DataFrame:
    requests = _ingestion_requests(spark, sf)
    chunks = ingestion.request_chunks(requests, windows=word_windows)
    return ingestion.ingestion_responses(requests, chunks)


@query(f"SELECT * FROM {_RESPONSES}")
def ingest_documents(spark, sf):
    return _responses(spark, sf)


@query(f"""SELECT count(*) FILTER (status = 'completed') AS successful, count(*) FILTER (status <> 'completed') AS failed,
  sum(chunks_created)::BIGINT AS total_chunks FROM {_RESPONSES}""")
def ingestion_summary(spark, sf):
    return ingestion.ingestion_summary(_responses(spark, sf))


_LONG = sn.window_chunks(
    "(SELECT doc_id, 'text: ' || lower(text) AS text FROM documents WHERE length(text) > 50)", "doc_id", "text"
)


@query(f"""SELECT '{{"extraction_results":{{"documents":' || (SELECT count(*) FROM documents) || ',"supplier":' || (SELECT count(*) FROM supplier)
  || '}},"validation_summary":{{"assets_validated":2,"total_rows":' || ((SELECT count(*) FROM documents) + (SELECT count(*) FROM supplier))
  || ',"total_columns":9}},"ingestion":{{"total_documents_ingested":' || (SELECT count(*) FROM documents WHERE length(text) > 50)
  || ',"total_chunks_created":' || (SELECT count(*) FROM {_LONG}) || '}},"run_status":"completed"}}' AS report""")
def lake_etl_report(spark, sf):
    """Raw to processed to curated to chunks; rows without long text drop out."""
    sources = {
        "documents": (texts(spark, sf, "documents"), "doc_id"),
        "supplier": (table(spark, sf, "supplier"), "s_suppkey"),
    }
    _, report = lake_etl.run(
        spark, shared_dir(spark, "etl"), sources, datetime(2024, 1, 30, 12), windows=word_windows
    )
    return report


# ---- sources ----


@query("""SELECT 'customer' AS "table", '{"key":' || c_custkey || ',"nation":' || c_nationkey || '}' AS data, NULL::DOUBLE AS balance FROM customer
UNION ALL SELECT 'supplier', '{"key":' || s_suppkey || ',"nation":' || s_nationkey || '}', s_acctbal FROM supplier""")
def union_sources(spark, sf):
    def part(name, prefix, extra=()):
        rows = table(spark, sf, name)
        key = F.struct(F.col(f"{prefix}key").alias("key"), F.col(f"{prefix[0]}_nationkey").alias("nation"))
        return rows.select(F.lit(name).alias("table"), F.to_json(key).alias("data"), *extra)

    return jdbc.union_sources([
        part("customer", "c_cust"), part("supplier", "s_supp", [F.col("s_acctbal").alias("balance")])
    ])


@query("""SELECT event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-15')""")
def incremental_extract(spark, sf):
    """Rows newer than the high-water mark of what was landed before."""
    events = table(spark, sf, "events")
    landed = events.filter("event_type = 'signup' and ts < timestamp_ntz'2024-01-15'")
    mark = jdbc.high_water_mark(landed, "ts")
    return jdbc.newer_than(events, "ts", mark).select("event_id", "event_type")


@query("""SELECT event_id, event_type, CASE WHEN ts IS NULL THEN 1 WHEN ts < TIMESTAMP '2024-01-10' THEN 1
  WHEN ts < TIMESTAMP '2024-01-11' THEN event_id % 3 + 1 WHEN ts < TIMESTAMP '2024-01-20' THEN 2 ELSE 3 END AS run FROM events""")
def late_ties_extract(spark, sf):
    """Three runs over a table whose mark is a day: rows of the mark's own day
    arrive after its run, twice; the last run is repeated."""
    root = shared_dir(spark, "extract")
    events = table(spark, sf, "events").select("event_id", "event_type", "ts", F.date_trunc("day", "ts").alias("day"))
    day = F.col("ts")
    there = [
        (day < "2024-01-10") | ((day < "2024-01-11") & (F.col("event_id") % 3 == 0)),
        (day < "2024-01-10") | ((day < "2024-01-11") & (F.col("event_id") % 3 <= 1)),
        (day < "2024-01-11"), (day < "2024-01-20"), F.lit(True), F.lit(True),
    ]
    found = [
        jdbc.extract_run(events.filter(where), "day", root, run, ["event_id"]).select("event_id", "event_type", F.lit(n).cast("long").alias("run"))
        for where, run, n in zip(there, (1, 2, 3, 4, 5, 5), (1, 2, 3, 2, 3, 3))
    ]
    return jdbc.union_sources([*found[:4], found[5]])


@query("""SELECT role AS collection, '{"_id":"' || conv_id || '","status":"published","turn":' || turn || '}' AS data FROM conversations
WHERE turn < 2""")
def scan_collections(spark, sf):
    """Collections exported as JSON lines, one equality filter, one missing collection."""
    root = shared_dir(spark, "collections")
    status = F.when(F.col("turn") < 2, "published").otherwise("draft")
    rows = table(spark, sf, "conversations").select("role", F.col("conv_id").alias("_id"), "turn", status.alias("status"))
    names = ("system", "user", "assistant")
    for role in names:
        rows.filter(F.col("role") == role).drop("role").write.json(f"{root}/{role}")
    found, _ = collections.scan_collections(spark, root, [*names, "absent"], {"status": "published"})
    return found


@query("""SELECT role AS collection, count(*) AS records, count(DISTINCT conv_id) AS conversations,
  (SELECT count(*) FROM conversations) AS records_ingested, (SELECT 4 - count(DISTINCT role) FROM conversations) AS records_failed,
  'completed' AS status, 'chat,batch_ingestion' AS tags FROM conversations GROUP BY role""")
def land_collections(spark, sf):
    """A source of four collections, of which one is absent, landed in the raw
    zone in small files and read back with its summary and catalog row."""
    export, root = shared_dir(spark, "exported"), shared_dir(spark, "lake")
    rows, names = table(spark, sf, "conversations"), ("system", "user", "assistant")
    for role in names:
        rows.filter(F.col("role") == role).select(F.col("conv_id").alias("_id"), "turn", "text").write.json(f"{export}/{role}")
    found = read_source(spark, "mongodb", {"root_path": export, "collections": [*names, "absent"]})
    landed = lake.land(found.rows, root, "chat", datetime(2024, 1, 30, 12), batch_size=500, problems=found.problems)
    summary = {k: F.lit(landed[k]).alias(k) for k in ("records_ingested", "records_failed", "status")}
    back = lake.load(spark, root, "raw", landed["asset"].first().key, "parquet").groupBy("collection").agg(
        F.count("*").alias("records"), F.countDistinct(F.get_json_object("data", "$._id")).alias("conversations")
    )
    tags = F.lit(",".join(lake.list_assets(lake.catalog(spark, root), zone="raw").first().tags)).alias("tags")
    return back.select("*", *summary.values(), tags)


@query("""SELECT 'customer' AS endpoint, c_custkey AS key, (row_number() OVER (ORDER BY c_custkey) - 1) // 500 + 1 AS page FROM customer
UNION ALL SELECT 'supplier', s_suppkey, (row_number() OVER (ORDER BY s_suppkey) - 1) // 500 + 1 FROM supplier""")
def scan_endpoints(spark, sf):
    """Tables served page by page; four tasks share an endpoint."""

    def fetch(endpoint: str, page: int, limit: int):
        import pyarrow.dataset as ds

        column = {"customer": "c_custkey", "supplier": "s_suppkey"}[endpoint]
        rows = ds.dataset(f"{sf}/{endpoint}.parquet")
        first = (page - 1) * limit
        wanted = (ds.field(column) >= first) & (ds.field(column) < first + limit)
        keys = sorted(rows.to_table([column], filter=wanted)[column].to_pylist())
        return {"data": [{"key": key} for key in keys]}

    records, _ = rest.scan_endpoints(spark, ["customer", "supplier"], fetch, page_size=500, stripes=4)
    return records.select("endpoint", F.get_json_object("data", "$.key").cast("long").alias("key"), "page")
