"""Tables of questions to tables of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quillmere.functions.scalars import let
from quillmere.functions.text import strip
from quillmere.operators.embedding import hashed_encoder
from quillmere.operators.response_cache import answer_with_cache
from quillmere.operators.search import top_k_bounded
from quillmere.session import written

MAX_QUERY = 1000
DEFAULT_RESULTS, MAX_RESULTS = 5, 20
DEFAULT_THRESHOLD = 0.7
BROADCAST_HITS = 500_000  # rows of ids, score and rank: some tens of megabytes

# Prompt, answer and fallback texts.
PROMPT_HEAD = (
    "You are a helpful AI assistant. Use the following context to answer the question.\n"
    "If you cannot answer the question based on the context, say so clearly.\n\nContext:\n"
)
PROMPT_QUESTION = "\n\nQuestion: "
PROMPT_TAIL = "\n\nAnswer:"
ANSWER = "Based on the provided context, "
ANSWER_USING = " can be answered using the information about "
NO_SOURCES = "I couldn't find relevant information to answer your question."
UNCLEAR = "I need more specific information to provide a detailed answer."
# Validation texts.
EMPTY_QUERY = "Query cannot be empty"
LONG_QUERY = "Query is too long"
BAD_RESULTS = "max_results out of range"
BAD_THRESHOLD = "similarity_threshold out of range"


def validate_requests(requests: DataFrame) -> DataFrame:
    """Defaults, trimmed query and the first broken rule (null: valid)."""

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in requests.columns else F.lit(default)

    raw = F.coalesce(F.col("query"), F.lit(""))
    results = given("max_results", DEFAULT_RESULTS)
    threshold = given("similarity_threshold", DEFAULT_THRESHOLD)
    error = (
        F.when((F.char_length(raw) < 1) | (strip(raw) == ""), F.lit(EMPTY_QUERY))
        .when(F.char_length(raw) > MAX_QUERY, F.lit(LONG_QUERY))
        .when(~results.between(1, MAX_RESULTS), F.lit(BAD_RESULTS))
        .when(~threshold.between(0.0, 1.0), F.lit(BAD_THRESHOLD))
    )
    return requests.withColumns(
        {
            "query": strip(raw),
            "max_results": results.cast("int"),
            "similarity_threshold": threshold.cast("double"),
            "error": error,
            "valid": error.isNull(),
        }
    )


def prompt(context: Column, question: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_QUESTION), question, F.lit(PROMPT_TAIL))


def template_answer(filled: Column) -> Column:
    """Answer read off the filled prompt, text marks included."""

    def reply(parts: Column) -> Column:
        context = strip(F.try_element_at(parts, F.lit(1)))
        question = strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
        text = F.concat(
            F.lit(ANSWER), F.lower(question), F.lit(ANSWER_USING), F.left(context, F.lit(100)), F.lit("...")
        )
        return F.when((context != "") & (question != ""), text).otherwise(F.lit(UNCLEAR))

    after = F.try_element_at(F.split(filled, "Context:"), F.lit(2))
    return let(F.split(after, "Question:"), reply)


def attach_content(
    hits: DataFrame, chunks: DataFrame, most_hits: int | None = None, include_metadata: bool = True
) -> DataFrame:
    """Content (and metadata) of the hits.

    ``most_hits`` is a known upper bound of their number.  If it is small the
    hits are broadcast, so that the chunk contents are scanned but never
    shuffled; otherwise the join is left to Catalyst.
    """
    columns = [c for c in ("content", "metadata", "document_id", "chunk_index") if c in chunks.columns]
    if not include_metadata:
        columns = [c for c in columns if c != "metadata"]
    wanted = chunks.select(F.col("id").alias("vector_id"), *columns)
    if most_hits is not None and most_hits <= BROADCAST_HITS:
        hits = F.broadcast(hits)
    return wanted.join(hits, "vector_id")


def answer(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """One response per question from its ranked sources (question_id,
    vector_id, score, rank, content and what else a source shows): answer,
    confidence, the sources and their ids.

    A question has at most k sources, so the collected lists are bounded."""
    shown = [c for c in ("document_id", "chunk_index", "metadata") if c in sources.columns]
    per_question = sources.groupBy("question_id").agg(
        F.avg("score").alias("_mean"),
        F.count("*").alias("_n"),
        F.array_sort(
            F.collect_list(F.struct("rank", "vector_id", "score", "content", *shown)),
            lambda a, b: a["rank"] - b["rank"],
        ).alias("_hits"),
    )
    joined = questions.join(per_question, "question_id", "left")
    context = F.array_join(F.col("_hits.content"), "\n\n")
    found = F.col("_hits").isNotNull()
    return joined.select(
        "question_id",
        "query",
        F.when(found, template_answer(prompt(context, F.col("query")))).otherwise(F.lit(NO_SOURCES)).alias("answer"),
        F.coalesce(F.col("_hits.vector_id"), F.array().cast("array<string>")).alias("source_ids"),
        F.coalesce(F.col("_mean"), F.lit(0.0)).alias("confidence_score"),
        F.coalesce("_n", F.lit(0)).alias("num_sources"),
        F.col("_hits").alias("sources"),
        *[F.col(c) for c in questions.columns if c not in ("question_id", "query", "embedding")],
    )


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = DEFAULT_RESULTS,
    threshold: float | None = DEFAULT_THRESHOLD,
    encoder: Callable[[Column], Column] | None = None,
    **search,
) -> DataFrame:
    """Embed the questions (question_id, query), search the embedded chunks,
    answer."""
    encode = encoder or hashed_encoder()
    asked = questions.withColumn("embedding", encode(F.col("query")))
    hits, most = top_k_bounded(asked, chunks, k, threshold, **search)
    return answer(questions, attach_content(hits, chunks, most))


def answer_requests(
    requests: DataFrame, chunks: DataFrame, cache: DataFrame, as_of, request_id: str = "request_id",
    encoder: Callable[[Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The whole question flow: validate, look up, embed and search with each
    request's own number of results and threshold, answer, remember.

    Returns the answers of the valid requests (response: JSON with answer,
    confidence_score, num_sources and the scored sources), the updated cache,
    and the rejected requests with their error.  A key is its query, number of
    results and threshold; each missed key is answered once.
    """
    checked = written(validate_requests(requests), "requests")
    parts = ("max_results", "similarity_threshold")
    encode = encoder or hashed_encoder()

    def answer_misses(asked: DataFrame) -> DataFrame:
        questions = asked.select(F.col("cache_key").alias("question_id"), "query", *parts)
        hits, most = top_k_bounded(
            questions.withColumn("embedding", encode(F.col("query"))), chunks, k=parts[0], threshold=parts[1]
        )
        found = answer(questions.select("question_id", "query"), attach_content(hits, chunks, most))
        shown = F.struct("answer", "confidence_score", "num_sources", "sources")
        cited = F.array_distinct(F.transform("sources", lambda h: h["document_id"].cast("string")))
        documents = F.coalesce(cited, F.array().cast("array<string>"))
        return found.select(
            F.col("question_id").alias("cache_key"), "query", F.to_json(shown).alias("response"),
            documents.alias("source_documents"),
        )

    valid = checked.filter("valid").select(request_id, "query", *parts)
    answers, remembered = answer_with_cache(valid, cache, answer_misses, as_of, request_id, parts)
    return answers, remembered, checked.filter("not valid")
