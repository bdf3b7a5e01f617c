"""The queries of problems 1 to 10 over the tables of a folder."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.llm import encoding, lookalike, mixing, near_duplicates, repeated_lines, responses, splitting, term_frequency, text_quality, truncation
from ledgerloom.llm.common import table

QUERIES = {}
PAIR = ["run_fingerprint", "qa_id", "retriever"]


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def p1_found(spark, d):
    terms = term_frequency.term_frequencies(table(spark, d, "chunks"), "chunk_id", "text")
    return terms.where("mark IS NOT NULL").select("term", "mark")


@query
def p1_terms(spark, d):
    return term_frequency.term_frequencies(table(spark, d, "chunks"), "chunk_id", "text")


def _pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"), "chunk_id", "text", "section_heading")


@query
def p2_found(spark, d):
    return _pieces(spark, d).where("piece_no = 0").select(F.col("item_id").alias("chunk_id")).distinct()


@query
def p2_pieces(spark, d):
    return _pieces(spark, d)


@query
def p2_cover(spark, d):
    """Of each split chunk its words, those of its pieces without their overlaps, and whether pieces keep the limit and follow each other with the overlap."""
    follow = Window.partitionBy("item_id").orderBy("piece_no")
    p = _pieces(spark, d).withColumn("overlap", F.lag("end_word").over(follow) - F.col("start_word"))
    return p.groupBy(F.col("item_id").alias("chunk_id")).agg(F.max("end_word").alias("words"), (F.sum("n_words") - 75 * (F.count(F.lit(1)) - 1)).alias("covered"), ((F.max("n_words") <= 400) & F.every((F.coalesce("overlap", F.lit(75)) == 75) & (F.size(F.filter(F.split("piece_text", r"(?U)\s+"), lambda w: w != "")) == F.col("n_words")))).alias("kept"))


def _kinds(spark, d):
    return text_quality.kinds_of_text(table(spark, d, "chunks"), "chunk_id", "text", table(spark, d, "chunk_labels"), keep=("word_count", "section_heading"))


@query
def p3_found(spark, d):
    return _kinds(spark, d).where("kind <> 'prose'").select(F.col("item_id").alias("chunk_id"), "kind").distinct()


@query
def p3_statistics(spark, d):
    return _kinds(spark, d)


def _looks(spark, d, only_changed):
    chunks = lookalike.normalize_lookalikes(table(spark, d, "chunks"), "chunk_id", ["text"], "chunks", only_changed)
    return chunks.unionByName(lookalike.normalize_lookalikes(table(spark, d, "eval_set"), "qa_id", ["question", "answer"], "eval_set", only_changed))


@query
def p4_found(spark, d):
    return _looks(spark, d, True).select("table_name", "row_key", "field_name").distinct()


@query
def p4_normalized(spark, d):
    return _looks(spark, d, False)


@query
def p5_found(spark, d):
    pairs = near_duplicates.near_duplicate_pairs(table(spark, d, "chunks"), "chunk_id", "text")
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


@query
def p5_groups(spark, d):
    return near_duplicates.near_duplicate_groups(table(spark, d, "chunks"), "chunk_id", "text")


@query
def p5_membership(spark, d):
    """Each chunk that takes part with the least id of its group."""
    return near_duplicates.near_duplicate_groups(table(spark, d, "chunks"), "chunk_id", "text").select(F.col("item_id").alias("chunk_id"), "group_id").distinct()


@query
def p6_found(spark, d):
    return repeated_lines.frequent_lines(table(spark, d, "chunks"), "chunk_id", "text", "cik", "ticker").select(F.col("item_id").alias("chunk_id"), "line_no").distinct()


@query
def p6_sequences(spark, d):
    return repeated_lines.frequent_sequences(table(spark, d, "chunks"), "chunk_id", "text", "cik", "ticker")


@query
def p6_clean(spark, d):
    return repeated_lines.remove_repeated_lines(table(spark, d, "chunks"), "chunk_id", "text", "cik", "ticker")


@query
def p7_found(spark, d):
    rows = table(spark, d, "eval_results").where("status = 'ok'")
    return responses.defective_pairs(rows, PAIR, "question", "llm_answer", "answerable", "ground_truth", table(spark, d, "documents"))


@query
def p7_evidence(spark, d):
    """The defective pairs by defect and by what decided."""
    rows = table(spark, d, "eval_results").where("status = 'ok'")
    judged = responses.judged_pairs(rows, PAIR, "question", "llm_answer", "answerable", "ground_truth", table(spark, d, "documents"))
    return judged.groupBy("defect", "evidence").agg(F.count(F.lit(1)).alias("pairs"))


@query
def p8_ids(spark, d):
    return encoding.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def _mixture(spark, d):
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source")


@query
def p9_mixture(spark, d):
    return _mixture(spark, d)[0]


@query
def p9_shares(spark, d):
    return _mixture(spark, d)[1]


def _evidence(spark, d):
    return truncation.truncation_evidence(table(spark, d, "documents"), "doc_id", "text", "source", "n_chars")


@query
def p10_found(spark, d):
    return _evidence(spark, d).where("truncated").select(F.col("id").alias("doc_id")).distinct()


@query
def p10_by_source(spark, d):
    return truncation.truncation_by_source(_evidence(spark, d))
