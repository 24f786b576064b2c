"""Queries over texts: cleaning, profiling, chunking, loading."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmere.functions import scalars as sc, text as tx
from quillmere.operators import chunking
from quillmere.operators.cleaning import drop_duplicate_content
from quillmere.plans import snippets as sn
from quillmere.plans.registry import entries, query, table, texts
from quillmere.session import shared_dir, written
from quillmere.sources import files
from quillmere.sources.registry import read_source


@query(f"SELECT doc_id, {sn.clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(f"SELECT doc_id, {sn.columns(sn.profile('text'))} FROM documents")
def text_profile(spark, sf):
    stats = tx.profile(F.col("text"))
    return texts(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in stats.items()])


@query(f"""SELECT doc_id, original_length, length(cleaned) AS cleaned_length, original_length AS token_count,
       CASE WHEN original_length = 0 THEN 0 ELSE greatest(1, ceil(original_length / 800.0)) END::BIGINT AS estimated_chunks,
       original_length <= 1000 AS fits_chunk
FROM (SELECT doc_id, length(text) AS original_length, {sn.clean('text')} AS cleaned FROM documents)""")
def text_processing_stats(spark, sf):
    length = F.char_length("text")
    return texts(spark, sf, "documents").select(
        "doc_id",
        length.alias("original_length"),
        F.char_length(tx.clean_text(F.col("text"))).alias("cleaned_length"),
        length.alias("token_count"),
        tx.estimated_chunks(length).alias("estimated_chunks"),
        tx.fits_chunk(length).alias("fits_chunk"),
    )


@query(f"SELECT doc_id, {sn.standardise('text')} AS standard FROM documents")
def standardise_text(spark, sf):
    return texts(spark, sf, "documents").select("doc_id", tx.standardise_text(F.col("text")).alias("standard"))


def window_chunks(spark, sf):
    return chunking.chunk_documents(
        texts(spark, sf, "documents"), "doc_id", "text", windows=chunking.word_windows
    )


@query(f"SELECT * FROM {sn.DOCUMENT_CHUNKS}")
def word_window_chunks(spark, sf):
    return window_chunks(spark, sf)


# Each word gets the end of the piece that would start there and the start of
# the next one (both ASOF joins on the running length); a recursive walk from
# the first word then visits the pieces.
@query(f"""WITH RECURSIVE
  cleaned AS (SELECT doc_id::VARCHAR AS d, {sn.clean('text')} AS c FROM documents),
  words AS (SELECT d, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS word
            FROM (SELECT d, string_split(c, ' ') AS w FROM cleaned WHERE c <> '')),
  ends AS (SELECT d, i, sum(length(word) + (i > 0)::INT) OVER (PARTITION BY d ORDER BY i) AS upto,
                  length(word) + (i > 0)::INT AS own FROM words),
  bounds AS (SELECT d, i, upto, own, upto - own AS before FROM ends),
  reach AS (SELECT b.d, b.i AS s, e.i AS last, e.upto FROM bounds b
            ASOF JOIN bounds e ON b.d = e.d AND b.before + 1000 >= e.upto),
  next AS (SELECT r.d, r.s, r.last, greatest(r.upto - 200, n.upto - 1000) AS low, n.i AS following
           FROM reach r LEFT JOIN bounds n ON n.d = r.d AND n.i = r.last + 1),
  step AS (SELECT n.d, n.s, n.last, n.following, least(b.i, n.following) AS then_start
           FROM next n ASOF LEFT JOIN bounds b ON n.d = b.d AND n.low <= b.before),
  walk AS (SELECT d, s, last, following, then_start, 0 AS k FROM step WHERE s = 0
           UNION ALL
           SELECT t.d, t.s, t.last, t.following, t.then_start, w.k + 1 FROM walk w
           JOIN step t ON t.d = w.d AND t.s = w.then_start WHERE w.following IS NOT NULL)
SELECT k.d || '_chunk_' || k.k AS id, k.d AS document_id, k.k::BIGINT AS chunk_index,
       array_to_string(string_split(c.c, ' ')[k.s + 1 : k.last + 1], ' ') AS content,
       count(*) OVER (PARTITION BY k.d) AS total_chunks
FROM walk k JOIN cleaned c ON c.d = k.d""")
def packed_chunks(spark, sf):
    return chunking.chunk_documents(texts(spark, sf, "documents"), "doc_id", "text")


_OWN = {"chunk_size": "length(content)", "chunk_token_count": "length(content)", **sn.profile("content")}


@query(f"""SELECT id, array_to_string(list_sort([{", ".join(f"'{n}=' || ({s})::VARCHAR" for n, s in _OWN.items())},
    'chunk_index=' || chunk_index, 'total_chunks=' || total_chunks, 'lang=' || lang, 'source=' || source]), ';') AS metadata
FROM {sn.window_chunks('documents', 'doc_id', 'text', ', lang, source')}""")
def chunk_metadata(spark, sf):
    given = F.create_map(
        F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("word_count"), F.lit("overridden")
    )
    documents = texts(spark, sf, "documents").withColumn("metadata", given)
    chunks = chunking.chunk_documents(
        documents, "doc_id", "text", windows=chunking.word_windows, metadata_col="metadata"
    )
    return chunking.with_chunk_metadata(chunks).select("id", entries(F.col("metadata")).alias("metadata"))


@query(f"""SELECT lang, count(DISTINCT document_id) AS documents, count(*) AS chunks,
  sum(length(content))::BIGINT AS chunk_chars, sum({sn.matches('content', f'[^{sn.SPACE}]+')})::BIGINT AS chunk_words,
  max(total_chunks) AS max_chunks_per_document
FROM {sn.window_chunks('documents', 'doc_id', 'text', ', lang')} GROUP BY lang""")
def chunk_summary_by_lang(spark, sf):
    """Clean, profile, cut and summarise: the minimal end-to-end slice."""
    documents = texts(spark, sf, "documents").withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang")))
    chunks = chunking.chunk_documents(
        documents, "doc_id", "text", windows=chunking.word_windows, metadata_col="metadata"
    )
    return chunks.groupBy(F.col("metadata")["lang"].alias("lang")).agg(
        # each document has exactly one first chunk: no distinct count needed
        F.count_if(F.col("chunk_index") == 0).alias("documents"),
        F.count("*").alias("chunks"),
        F.sum(F.char_length("content")).alias("chunk_chars"),
        F.sum(tx.word_count(F.col("content"))).alias("chunk_words"),
        F.max("total_chunks").alias("max_chunks_per_document"),
    )


@query(f"""SELECT doc_id, lang FROM documents WHERE doc_id IN
  (SELECT min(doc_id) FROM documents GROUP BY {sn.standardise('text')})""")
def content_deduplication(spark, sf):
    return drop_duplicate_content(texts(spark, sf, "documents"), "doc_id", "text").select("doc_id", "lang")


_HIDDEN = (
    r"(?is)<!--.*?-->|<script\b.*?</script[^>]*>|<style\b.*?</style[^>]*>|<head\b.*?</head[^>]*>"
)


def _html_sql(html: str) -> str:
    text = sn.replace(html, _HIDDEN, "")
    text = sn.replace(text, rf"(?i)</?(?:{tx.BLOCK_TAGS})\b[^>]*>", "\n")
    text = sn.replace(text, "<[^>]+>", "")
    for entity, char in tx.ENTITIES.items():
        text = f"replace({text}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    text = f"replace({text}, '&amp;', '&')"
    text = sn.replace(text, f"[{sn.HORIZONTAL}]+", " ")
    return sn.strip(sn.replace(text, r" ?\n[ \n]*", "\n"))


@query(f"SELECT page_id, {_html_sql('html')} AS content FROM pages")
def html_to_text(spark, sf):
    return texts(spark, sf, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("content"))


def _markdown_sql(text: str) -> str:
    for pattern, kept in tx.MARKDOWN_RULES:
        text = sn.replace(text, pattern, kept.replace("$", "\\"))
    return sn.strip(text)


_MARKDOWN = (
    "'# ' || source || chr(10) || chr(10) || '- **' || lang || '** [link](http://x/' || doc_id || ') `code`' "
    "|| chr(10) || '1. *one* <b>two</b>' || chr(10) || '```' || chr(10) || '> ' || text"
)


@query(f"SELECT doc_id, {_markdown_sql('md')} AS content FROM (SELECT doc_id, {_MARKDOWN} AS md FROM documents)")
def markdown_to_text(spark, sf):
    md = F.concat(
        F.lit("# "), F.col("source"), F.lit("\n\n- **"), F.col("lang"), F.lit("** [link](http://x/"),
        F.col("doc_id").cast("string"), F.lit(") `code`\n1. *one* <b>two</b>\n```\n> "), F.col("text"),
    )
    return texts(spark, sf, "documents").select("doc_id", tx.markdown_to_text(md).alias("content"))


@query("""SELECT doc_id, 'CSV Data from ' || doc_id || '.csv:' || chr(10) || chr(10) || 'Columns: id, text' || chr(10)
  || 'Total rows: 2' || chr(10) || chr(10) || 'Sample data:' || chr(10) || doc_id || ',"' || replace(text, '"', '""')
  || '"' || chr(10) || 'last,"' || lang || '"' AS content FROM documents""")
def csv_digest(spark, sf):
    """Quoted fields keep their line breaks inside one record."""
    body = F.concat(
        F.lit('id,"text"\n'), F.col("doc_id").cast("string"), F.lit(',"'),
        F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"\nlast,"'), F.col("lang"), F.lit('"\n'),
    )
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".csv"))
    return texts(spark, sf, "documents").select("doc_id", tx.csv_digest_text(name, body).alias("content"))


_CSV_DOCS = 5000  # ids of one file
_CSV_SPLIT = 256 << 10  # bytes


@query(f"""WITH r AS (SELECT doc_id // {_CSV_DOCS} AS part, doc_id, doc_id || ',"' || replace(replace(replace(text, chr(13) || chr(10), chr(10)),
    chr(13), chr(10)), '"', '""') || '",' || lang AS record FROM documents)
SELECT part, count(*) AS total_rows, 'Columns: id, text, with a "comma", lang' || chr(10) || 'Total rows: ' || count(*) || chr(10) || chr(10)
  || 'Sample data:' || chr(10) || string_agg(record, chr(10) ORDER BY doc_id) FILTER (place <= 10) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id) AS place FROM r) GROUP BY part""")
def csv_digest_of_splits(spark, sf):
    """CSV files of documents, line breaks in quotes, each cut in many splits."""
    root = shared_dir(spark, "csv")
    docs = table(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / _CSV_DOCS))
    record = F.concat(
        F.col("doc_id").cast("string"), F.lit(',"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('",'), F.col("lang"))
    header = docs.select("part").distinct().select(
        "part", F.lit(None).cast("long").alias("doc_id"), F.lit('id,"text, with a ""comma""",lang').alias("value"))
    rows = header.unionByName(docs.select("part", "doc_id", record.alias("value")))
    rows.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first()).select("part", "value").write.partitionBy(
        "part").text(root)
    cut = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(_CSV_SPLIT))
    try:
        found = written(files.csv_digest(spark, f"{root}/part=*"), "digests")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    return found.select(
        F.regexp_extract("file_path", "part=([0-9]+)", 1).cast("long").alias("part"), "total_rows",
        F.regexp_replace("content", "^CSV Data from [^\n]*:\n\n", "").alias("digest"),
    )


_PATHS = """(SELECT 'lake/' || source || '/' || doc_id || CASE lang WHEN 'en' THEN '.TXT' WHEN 'de' THEN '.htm'
    WHEN 'es' THEN '.docx' ELSE '.tar.unknown' END AS file_path, text AS content,
    octet_length(encode(text)) AS file_size FROM documents)"""


def _document_files(spark, sf):
    suffix = (
        F.when(F.col("lang") == "en", ".TXT").when(F.col("lang") == "de", ".htm").when(F.col("lang") == "es", ".docx")
        .otherwise(".tar.unknown")
    )
    return texts(spark, sf, "documents").select(
        F.concat(F.lit("lake/"), "source", F.lit("/"), F.col("doc_id").cast("string"), suffix).alias("file_path"),
        F.col("text").cast("binary").alias("content"),
        F.octet_length("text").alias("file_size"),
    )


_TYPED = f"""(SELECT *, string_split(file_path, '/')[-1] AS filename,
  CASE lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) WHEN '.txt' THEN 'txt' WHEN '.htm' THEN 'html'
    WHEN '.docx' THEN 'docx' ELSE 'txt' END AS file_type FROM {_PATHS})"""


@query(f"""SELECT file_path, filename, file_size, file_type, file_size <= 52428800 AS valid,
  CASE WHEN file_size > 52428800 THEN 'File too large: ' || file_size || ' bytes (max: 52428800)' END AS error
FROM (SELECT * REPLACE (CAST(file_size * 10000 AS BIGINT) AS file_size) FROM {_TYPED})""")
def file_validation(spark, sf):
    """The listing alone, each file as if it were ten thousand times its size."""
    listing = _document_files(spark, sf).drop("content").withColumn("file_size", F.col("file_size").cast("long") * 10_000)
    return files.validate_files(listing)


@query(f"""SELECT file_path, filename, file_type, file_size, valid,
  CASE WHEN valid THEN CASE WHEN file_type = 'html' THEN {_html_sql('content')} ELSE {sn.strip('content')} END END AS content,
  CASE WHEN NOT valid THEN 'no text reader for docx' END AS error
FROM (SELECT *, file_type <> 'docx' AS valid FROM {_TYPED})""")
def load_documents(spark, sf):
    return files.load_documents(_document_files(spark, sf))


@query("""SELECT page_id, string_split(url, '/')[-1] AS last_part, 'processed_' || string_split(url, '/')[-1] AS processed_key,
  'tag,' || page_id AS joined, 2::BIGINT AS tags FROM pages""")
def key_and_tag_helpers(spark, sf):
    tags = sc.split_tags(F.concat(F.lit("tag,"), F.col("page_id").cast("string")))
    last = tx.file_name(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", last.alias("last_part"), F.concat(F.lit("processed_"), last).alias("processed_key"),
        sc.join_tags(tags).alias("joined"), F.size(tags).alias("tags"),
    )


@query("""SELECT conv_id, turn, 'rag_query:' || md5(text) AS cache_key,
  'rag_query:' || md5(text || chr(1) || '5' || chr(1) || role) AS request_key FROM conversations""")
def cache_keys(spark, sf):
    q = F.col("text")
    return texts(spark, sf, "conversations").select(
        "conv_id", "turn", sc.cache_key(q).alias("cache_key"),
        sc.cache_key(q, F.lit(5), F.col("role")).alias("request_key"),
    )


@query("""SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k,
  '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS row_json FROM events""")
def json_rows(spark, sf):
    return table(spark, sf, "events").select(
        "event_id",
        F.variant_get(F.parse_json("props"), "$.k", "long").alias("k"),
        F.to_json(F.struct("event_id", "event_type")).alias("row_json"),
    )


def _text_files(spark, sf) -> str:
    """The documents as text files below a folder for each source."""
    path = shared_dir(spark, "text-files")
    table(spark, sf, "documents").select("text", "source").write.partitionBy("source").text(path)
    return path


_FILE_SUMS = """SELECT source, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
  CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines FROM documents"""


@query(f"{_FILE_SUMS} GROUP BY source")
def object_scan(spark, sf):
    """Documents stored as objects by source, listed and read back."""
    found = files.scan_objects(spark, _text_files(spark, sf), "").filter(F.endswith("key", F.lit(".txt")))
    return _file_sums(found.withColumn("source", F.regexp_extract("key", "source=([^/]+)/", 1)), "size")


@query(f"{_FILE_SUMS} GROUP BY source")
def directory_scan(spark, sf):
    found = files.scan_directory(spark, _text_files(spark, sf), ["*.txt", "*.text"])
    return _file_sums(found.withColumn("source", F.regexp_extract("file_path", "source=([^/]+)/", 1)), "file_size")


def _file_sums(found, size):
    text = F.col("content").cast("string")
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return found.groupBy("source").agg(F.sum(size).alias("bytes"), F.sum(lines).cast("long").alias("lines"))


@query(f"""SELECT kind, s.* FROM (SELECT unnest(['s3', 'filesystem']) AS kind), ({_FILE_SUMS} GROUP BY source) s""")
def read_sources(spark, sf):
    """One folder as two kinds of source, through the configured entry point."""
    path, found = _text_files(spark, sf), []
    for kind, config, name, size in (
        ("s3", {"bucket": path, "prefix": ""}, "key", "size"),
        ("filesystem", {"root_path": path, "file_patterns": ["*.txt"]}, "file_path", "file_size"),
    ):
        rows = read_source(spark, kind, config).rows.filter(F.endswith(name, F.lit(".txt")))
        rows = rows.withColumn("source", F.regexp_extract(name, "source=([^/]+)/", 1))
        found.append(_file_sums(rows, size).select(F.lit(kind).alias("kind"), "source", "bytes", "lines"))
    return found[0].unionByName(found[1])
