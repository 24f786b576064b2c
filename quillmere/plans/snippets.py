"""SQL fragments shared by the check queries."""

from __future__ import annotations

from quillmere.functions import text as tx
from quillmere.operators.answering import ANSWER, ANSWER_USING, NO_SOURCES

HORIZONTAL = (
    r"\t\x0B-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
SPACE = r"\n" + HORIZONTAL


def replace(value: str, pattern: str, new: str) -> str:
    pattern, new = pattern.replace("'", "''"), new.replace("'", "''")
    return f"regexp_replace({value}, '{pattern}', '{new}', 'g')"


def strip(value: str) -> str:
    return replace(replace(value, rf"\A[{SPACE}]+", ""), rf"[{SPACE}]+\z", "")


def squeeze(value: str) -> str:
    return f"trim({replace(value, f'[{SPACE}]+', ' ')})"


def clean(value: str) -> str:
    quoted = f"translate({value}, '“”`‘’', '\"\"\"''''')"
    kept = replace(quoted, f"[^{tx.WORD}{SPACE}{tx.KEPT_PUNCTUATION}]+", "")
    return f"coalesce({squeeze(replace(kept, r'[.!?]+([.!?])', r'\1'))}, '')"


def standardise(value: str) -> str:
    return f"lower({squeeze(replace(value, f'[^{tx.WORD}{SPACE}]+', ''))})"


def matches(value: str, pattern: str) -> str:
    return f"len(regexp_extract_all({value}, '{pattern}'))"


def profile(value: str) -> dict[str, str]:
    english = " + ".join(f"contains(lower({value}), '{w}')::INT" for w in tx.ENGLISH_WORDS)
    return {
        "word_count": matches(value, f"[^{SPACE}]+"),
        "char_count": f"length({value})",
        "paragraph_count": f"len(list_filter(string_split({value}, chr(10) || chr(10)), "
        f"lambda p: regexp_matches(p, '[^{SPACE}]')))",
        "sentence_count": matches(value, rf"[^.!?{SPACE}][^.!?]*"),
        "english_word_count": f"({english})::BIGINT",
        "has_accented_chars": f"regexp_matches({value}, '{tx.ACCENTED}')",
        "has_cyrillic": f"regexp_matches({value}, '{tx.CYRILLIC}')",
        "has_chinese": f"regexp_matches({value}, '{tx.CHINESE}')",
    }


def columns(parts: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in parts.items())


def window_chunks(source: str, key: str, text: str, carried: str = "") -> str:
    """Chunks of 200 words, 40 shared: document_id, chunk_index, content, total_chunks."""
    return f"""(
      SELECT document_id || '_chunk_' || i AS id, document_id, i::BIGINT AS chunk_index,
             array_to_string(words[i * 160 + 1 : i * 160 + 200], ' ') AS content,
             total_chunks::BIGINT AS total_chunks {carried}
      FROM (SELECT *, unnest(range(total_chunks)) AS i
            FROM (SELECT *, greatest(0, ceil((len(words) - 200) / 160.0))::BIGINT + 1 AS total_chunks
                  FROM (SELECT {key}::VARCHAR AS document_id, string_split({clean(text)}, ' ') AS words {carried}
                        FROM {source}) WHERE words[1] <> '')))"""


DOCUMENT_CHUNKS = window_chunks("documents", "doc_id", "text")

# crc32 as in java.util.zip.CRC32, over the distinct terms
TERM_BUCKETS = r"""
  crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM range(256) r(i))),
  buckets AS (SELECT term, xor(list_reduce([4294967295::BIGINT] ||
      list_transform(range(octet_length(encode(term))), lambda i: ('0x' || substr(hex(encode(term)), 2 * i + 1, 2))::BIGINT),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 384 AS bucket
    FROM (SELECT DISTINCT term FROM terms), crc_table)"""


def weights(source: str, key: str, text: str, name: str) -> str:
    """CTEs terms_<name>: (id, term) and weights_<name>: (id, bucket, w)."""
    return f"""
  weights_{name} AS (SELECT id, bucket, (n / sqrt(sum(n * n) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS w
    FROM (SELECT id, bucket, count(*)::DOUBLE AS n FROM
            (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[{tx.WORD}]+')) AS term FROM {source})
          JOIN buckets USING (term) GROUP BY id, bucket))"""


def terms(*sources: tuple[str, str]) -> str:
    union = " UNION ALL ".join(
        f"SELECT unnest(regexp_extract_all(lower({text}), '[{tx.WORD}]+')) AS term FROM {source}"
        for source, text in sources
    )
    return f"terms AS ({union})"


LOGS = """(
  SELECT event_id AS id, user_id, props AS query_text, round(value * 20)::BIGINT AS response_time_ms,
         user_id % 6 AS num_results,
         CASE WHEN event_type <> 'error' THEN round(least(value / 100, 1.0), 4) END AS confidence_score,
         event_type = 'view' AS cached, ts AS created_at,
         CASE WHEN event_type IN ('purchase', 'signup') THEN 'POST' ELSE 'GET' END AS method,
         '/' || event_type AS endpoint,
         CASE WHEN event_type <> 'error' THEN '200' WHEN value > 50 THEN '500' ELSE '404' END AS status
  FROM events)"""
AS_OF = "2024-01-30 12:00:00"
NOW = f"TIMESTAMP '{AS_OF}'"

STORED = """(
  SELECT doc_id::VARCHAR AS id, source, lang, octet_length(encode(text)) AS file_size,
         CASE WHEN n_chars >= 100 THEN 'completed' ELSE 'pending' END AS status,
         CASE WHEN n_chars = 0 THEN 0 ELSE greatest(1, ceil(n_chars / 800.0)) END::BIGINT AS chunk_count
  FROM documents)"""

ASSETS = """(
  SELECT CASE lang WHEN 'en' THEN 'raw' WHEN 'de' THEN 'processed' WHEN 'es' THEN 'curated' ELSE 'documents' END AS zone,
         source || '/' || doc_id AS key, CASE WHEN n_chars > 2000 THEN 'parquet' ELSE 'text' END AS format,
         octet_length(encode(text)) AS size_bytes,
         TIMESTAMP '2023-06-01 00:00:00' + INTERVAL 1 MINUTE * (n_chars * 37) AS created_at,
         [lang, source] AS tags, source
  FROM documents)"""

DIRTY_EVENTS = """(
  SELECT event_id, user_id, CASE WHEN value >= 5 THEN value END AS value,
         CASE WHEN event_type = 'click' THEN NULL ELSE chr(9) || ' ' || upper(event_type) || chr(160) END AS event_type
  FROM events
  UNION ALL
  SELECT event_id, user_id, CASE WHEN value >= 5 THEN value END, chr(9) || ' ' || upper(event_type) || chr(160)
  FROM events WHERE event_type = 'error')"""


def answer(question: str, context: str) -> str:
    asked = strip(f"{question} || chr(10) || chr(10) || 'Answer:'")
    return (
        f"CASE WHEN {context} IS NULL THEN '{NO_SOURCES.replace(chr(39), chr(39) * 2)}' "
        f"ELSE '{ANSWER}' || lower({asked}) || '{ANSWER_USING}' || left({strip(context)}, 100) || '...' END"
    )
