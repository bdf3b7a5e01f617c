"""Scores of retrieval and answers; null where a score does not apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import dot, is_missing, parse_judge, pipe_list, scoring_tokens, strip, unit

METRICS = ("retrieval_success", "generation_success", "document_recall_at_k", "document_reciprocal_rank", "chunk_recall_at_k", "chunk_reciprocal_rank", "cosine_sim", "word_overlap_f1", "llm_score")
# fixed values: least and greatest value of each metric
RANGES = {m: (0.0, 1.0) for m in METRICS} | {"cosine_sim": (-1.0, 1.0), "llm_score": (1.0, 5.0)}
STATUSES = ("ok", "generation_error", "retrieval_error")


def overall_status(retrieval: Column, generation: Column) -> Column:
    """The status of a result: that of the first stage that failed; null for combinations that cannot be."""
    return F.when((retrieval == "ok") & (generation == "ok"), "ok").when((retrieval == "ok") & (generation == "error"), "generation_error").when((retrieval == "error") & (generation == "not_run"), "retrieval_error")


def gold_documents(source_doc_ids: Column, source_doc_id: Column) -> Column:
    """The plural list, else the single id unless it is a ``_MULTI`` marker; distinct."""
    single = strip(F.coalesce(source_doc_id, F.lit("")))
    one = F.when((single != "") & ~single.endswith("_MULTI"), F.array(single)).otherwise(F.array().cast("array<string>"))
    many = F.array_distinct(pipe_list(source_doc_ids))
    return F.when(F.size(many) > 0, many).otherwise(one)


def recall(gold: Column, retrieved: Column) -> Column:
    """Share of the gold ids that were retrieved; null without gold."""
    return F.when(F.size(gold) > 0, F.round(F.size(F.array_intersect(gold, retrieved)) / F.size(gold), 6))


def reciprocal_rank(gold: Column, retrieved: Column) -> Column:
    """1 / rank of the first gold id, 0 if none was retrieved; null without gold."""
    ranks = F.filter(F.transform(gold, lambda g: F.array_position(retrieved, g)), lambda p: p > 0)
    return F.when(F.size(gold) > 0, F.when(F.size(ranks) > 0, F.round(1 / F.array_min(ranks), 6)).otherwise(0.0))


def token_f1(predicted: Column, expected: Column) -> Column:
    """F1 of the two bags of words, to four places; 0 where either is empty."""
    a, b = scoring_tokens(predicted), scoring_tokens(expected)
    # of each distinct word the smaller of its two counts
    count = lambda x, w: F.size(F.filter(x, lambda y: y == w))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, w: s + F.least(count(a, w), count(b, w)))
    # 2pr / (p + r) with p = both / |a| and r = both / |b|
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(2.0 * both / (F.size(a) + F.size(b)), 4))


def score_results(results: DataFrame, answer_vector: str | None = None, reference_vector: str | None = None, judge: str | None = None) -> DataFrame:
    """``results`` with the nine metrics.

    Failed rows keep their retrieval scores; answers are scored where the
    generation is ok and there is a reference. Without vectors and judge texts
    their metrics are null.
    """
    retrieval, generation = F.col("retrieval_status") == "ok", F.col("generation_status") == "ok"
    answered = generation & ~is_missing(F.col("ground_truth"))
    docs, chunks = pipe_list(F.col("retrieved_doc_ids")), pipe_list(F.col("retrieved_chunk_ids"))
    gold, gold_chunks = gold_documents(F.col("source_doc_ids"), F.col("source_doc_id")), F.array_distinct(pipe_list(F.col("source_chunk_ids")))
    none = F.lit(None).cast("double")
    cosine = F.round(dot(unit(F.col(answer_vector)), unit(F.col(reference_vector))), 6) if answer_vector and reference_vector else none
    return results.withColumns(
        {
            "retrieval_success": retrieval.cast("double"),
            "generation_success": generation.cast("double"),
            "document_recall_at_k": F.when(retrieval, recall(gold, docs)),
            "document_reciprocal_rank": F.when(retrieval, reciprocal_rank(gold, docs)),
            "chunk_recall_at_k": F.when(retrieval, recall(gold_chunks, chunks)),
            "chunk_reciprocal_rank": F.when(retrieval, reciprocal_rank(gold_chunks, chunks)),
            "cosine_sim": F.when(answered, cosine),
            "word_overlap_f1": F.when(answered, token_f1(F.col("llm_answer"), F.col("ground_truth"))),
            "llm_score": F.when(answered, parse_judge(F.col(judge)).cast("double")) if judge else none,
        }
    )


def prompt_context(hits: DataFrame, query: str) -> DataFrame:
    """The chunks of each query as the context of a prompt, in the order of rank."""
    one = F.concat(F.lit("[Chunk "), F.col("rank").cast("string"), F.lit("] "), F.col("filing_type"), F.lit(" ("), F.col("filing_date"), F.lit(") - "), F.col("section_heading"), F.lit(":\n"), F.col("text"))
    return hits.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("t")))).alias("x")).select(query, F.array_join(F.transform("x", lambda s: s["t"]), "\n\n").alias("context"))


def embedding_document() -> Column:
    """Labelled lines of what is known of a chunk, then its text."""
    def known(c):
        return F.when(~is_missing(F.col(c)) & (F.lower(strip(F.col(c))) != "nan"), strip(F.col(c)))

    labels = (("Company", "company"), ("Ticker", "ticker"), ("Filing type", "filing_type"), ("Filing date", "filing_date"), ("Section", "section_heading"))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), known(c)) for label, c in labels], F.lit("Content:"), F.col("text"))
