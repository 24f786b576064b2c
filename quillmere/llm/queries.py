"""The operators of this package applied to whole tables, with production
parameters, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmere.llm import (
    bpe, decontamination, divergence_audit, exact_dedup, jaccard_join, license_scan, packing, periodic_runs,
    quality_ranking, substring_dedup, token_files, toxicity, warc,
)
from quillmere.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


@query("op2_exact_dedup", r"""
    WITH n AS (
        SELECT doc_id, coalesce(text, '') AS body,
            regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
        FROM documents),
    r AS (
        SELECT doc_id, sha256(norm) AS text_sha256,
            first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id) AS keep_id,
            count(*) OVER (PARTITION BY norm) AS group_size
        FROM n)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
""")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    decided = exact_dedup.find_duplicates(table(spark, sf, "documents"))
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op9_bradley_terry_quality")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return quality_ranking.score(docs, quality_ranking.fit(docs, table(spark, sf, "labels")))


@query("op3_toxic_segments")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


@query("op8_benchmark_tiling")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_warc_index_merge", """
    WITH p AS (
        SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
        FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
    FROM f
""")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf, "pages"), shared_dir(spark, "archive"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op10_rans_token_files")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "token-files")
    token_files.write_tokens(table(spark, sf, "documents"), path)
    return token_files.read_tokens(spark, path)


@query("op4_license_notices")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan(table(spark, sf, "documents"))


@query("op5_repeated_passages", r"""
    WITH w AS (
        SELECT doc_id,
            list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w),
    g AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS win FROM i),
    f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM g),
    c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM f WHERE first_doc < doc_id),
    x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    k AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
        FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
        sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN k USING (doc_id)
""")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf, "documents")).drop("spans")


@query("op6_jaccard_count_tree", r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
        FROM documents),
    i AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS p FROM w WHERE len(ws) > 0),
    s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 3], ' ') AS sh FROM i),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    o AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
        FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (
        SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
        WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
    r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other),
    c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)
""")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard_join.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op11_bpe_tree_concatenation")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    both = bpe.decode(bpe.encode(table(spark, sf, "documents")))
    return both.select(
        "doc_id", F.floor(F.octet_length("token_ids") / 4).alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query("op12_source_divergence", r"""
    WITH d AS (
        SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
        FROM documents),
    o AS (SELECT lang, source, r, unnest(ws) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM o GROUP BY ALL),
    k AS (
        SELECT lang, term, CAST(sum(n) AS HUGEINT) AS lang_n FROM c GROUP BY lang, term HAVING sum(docs) >= 30),
    v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(lang_n) AS total FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    m AS (
        SELECT g.lang, g.source, k.term, k.lang_n, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
        FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, sum(n) AS total FROM m GROUP BY lang, source),
    p AS (
        SELECT m.lang, m.source, m.term, m.n, 1 + (1000000000 * (m.n + 5)) // (s.total + 5 * v.v) AS p,
            1 + (1000000000 * (m.lang_n + 5)) // (v.total + 5 * v.v) AS q
        FROM m JOIN s USING (lang, source) JOIN v USING (lang)),
    x AS (
        SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    y AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM y QUALIFY part = 'pair' OR rank <= 50
""")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return divergence_audit.audit(table(spark, sf, "documents"))


@query("op13_periodic_runs", r"""
    WITH d AS (
        SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
            xor(list_reduce(
                [4294967295] || flatten(list_transform(
                    string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda s, b: CASE WHEN b >= 0 THEN xor(s, b) ELSE xor(s >> 1, (s & 1) * 3988292384) END), 4294967295) AS h
        FROM documents),
    b AS (SELECT doc_id, ws, CAST(len(ws) AS BIGINT) AS n, h % 10 = 0 AND len(ws) > 0 AS turned, h // 10 AS g FROM d),
    a AS (SELECT *, CASE WHEN turned THEN g % n END AS a FROM b),
    p AS (SELECT *, CASE WHEN turned THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
    t AS (
        SELECT doc_id, n, CASE WHEN turned THEN list_transform(
            range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws
        FROM p),
    w AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 8], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(n - 7)) AS i FROM t)),
    e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.win = y.win AND x.i < y.i),
    s AS (
        SELECT doc_id, q, min(i) AS b, max(i) + 8 + q AS e
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e)
        GROUP BY doc_id, q, island HAVING max(i) + 8 + q - min(i) >= greatest(24, 3 * q)),
    r AS (
        SELECT doc_id, b AS start, e - b AS length, q AS period FROM s
        WHERE NOT EXISTS (
            SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.q < s.q AND o.b <= s.b AND o.e >= s.e)),
    l AS (
        SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
        FROM r GROUP BY doc_id),
    m AS (
        SELECT doc_id, start, length, period FROM r WHERE NOT EXISTS (
            SELECT 1 FROM r o WHERE o.doc_id = r.doc_id AND (o.length * r.period > r.length * o.period
                OR o.length * r.period = r.length * o.period AND (o.start, o.period) < (r.start, r.period)))),
    k AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept
        FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM t) x
        WHERE NOT EXISTS (
            SELECT 1 FROM r WHERE r.doc_id = x.doc_id AND x.i >= r.start + r.period AND x.i < r.start + r.length)
        GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
        sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
    FROM t LEFT JOIN l USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
""")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_runs.with_planted_periods(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = found.withColumn("best", periodic_runs.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
