"""Every query over the tables of a folder, with the SQL that gives the same."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, cleaning, dense, lexical, profile, scoring, selection, validation
from ledgerloom.plans import inputs
from ledgerloom.plans.oracle import ORACLE as _SQL
from ledgerloom.session import ensure_checkpoint_dir
from ledgerloom.sources import tables
from ledgerloom.sources.tables import read_parquet, spread

QUERIES, COUNTS, K = {}, {"10-K": 1, "10-Q": 1, "8-K": 1}, 5


def query(f):
    QUERIES[f.__name__] = f
    return f


# windows and reports on chunks


@query
def chunk_documents(spark, d):
    """Windows of 400 words, 75 of them shared, of all documents."""
    docs = spread(read_parquet(spark, d, "documents").select("doc_id", "text"))
    cut = docs.select("doc_id", F.posexplode(chunking.windows(T.words(F.col("text")), 400, 75)).alias("chunk_index", "w"))
    return cut.select("doc_id", "chunk_index", F.col("w.start").alias("start_word"), F.col("w.n").alias("word_count"), F.md5("w.text").alias("text_md5"))


@query
def chunk_profile(spark, d):
    return profile.chunk_profile(inputs.chunks(spark, d, "ticker", "filing_type", "accession_number", "word_count", "section_heading"), ["ticker", "filing_type"])


@query
def chunk_word_stats(spark, d):
    return profile.describe(inputs.chunks(spark, d, "ticker", "word_count"), F.col("word_count"), ["ticker"])


@query
def length_stats(spark, d):
    c = read_parquet(spark, d, "cleaning_manifest")
    return profile.describe(c, F.col("raw_length")).select(F.lit("raw").alias("what"), "*").unionByName(profile.describe(c, F.col("cleaned_length")).select(F.lit("cleaned").alias("what"), "*"))


@query
def section_profile(spark, d):
    return profile.section_profile(inputs.chunks(spark, d, "section_heading", "ticker", "filing_type"))


@query
def missingness(spark, d):
    parts = [
        profile.missingness(inputs.chunks(spark, d, "company", "ticker", "cik", "filing_date", "section_heading", "text", "word_count"), "chunks", ["company", "ticker", "cik", "filing_date", "section_heading", "text", "word_count", "not_a_field"]),
        profile.missingness(read_parquet(spark, d, "filings"), "filings", ["source_url", "human_readable_warning", "filing_date"]),
        profile.missingness(read_parquet(spark, d, "cleaning_manifest"), "cleaning_manifest", ["raw_length", "human_readable_warning", "warnings"]),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def outlier_counters(spark, d):
    raw = read_parquet(spark, d, "chunks")
    w = F.col("word_count")
    found = profile.counters(raw, {"empty_chunk_text_rows": T.is_missing(F.col("text")), "oversized_chunks": F.coalesce(w > 400, F.lit(False)), "short_chunks_under_100_words": F.coalesce(w < 100, F.lit(False))})
    twice = raw.groupBy("chunk_id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("count")).select(F.lit("duplicate_chunk_ids").alias("metric"), "count")
    m = read_parquet(spark, d, "cleaning_manifest")
    low = profile.counters(m, {"low_retention_filings_under_15_pct": F.coalesce(F.col("cleaned_length") / F.nullif("raw_length", F.lit(0)) < 0.15, F.lit(False)), "human_readable_text_fallbacks": F.coalesce(F.col("human_readable_format") == "text", F.lit(False))})
    return found.unionByName(twice).unionByName(low)


@query
def coverage(spark, d):
    """Average words, and the share of chunks with a known heading."""
    known = F.count_if(~T.is_missing(F.col("section_heading")) & (F.lower(T.strip(F.col("section_heading"))) != "unknown"))
    return inputs.chunks(spark, d, "word_count", "section_heading").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("word_count") + 1e-9, 2).alias("mean_words"), T.share(known, F.count(F.lit(1))).alias("known_heading_pct"))


@query
def retention(spark, d):
    m = read_parquet(spark, d, "cleaning_manifest")
    raw = F.col("raw_length")
    return m.select("accession_number", F.when(raw > 0, F.round(F.col("cleaned_length") / raw, 4)).otherwise(0.0).alias("retained_ratio"), F.coalesce(T.share(F.col("cleaned_length"), raw), F.lit(0.0)).alias("retained_pct"))


@query
def filing_counts(spark, d):
    return inputs.filings(spark, d).groupBy("ticker", "filing_type").agg(F.count(F.lit(1)).alias("filings"))


@query
def filing_counts_map(spark, d):
    """The counts of a ticker as one value."""
    pair = F.concat(F.col("filing_type"), F.lit("="), F.col("filings").cast("string"))
    return filing_counts(spark, d).groupBy("ticker").agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("filing_type_counts"))


@query
def filing_timeline(spark, d):
    return inputs.filings(spark, d).where("filed IS NOT NULL").groupBy("ticker").agg(F.min("filed").cast("string").alias("first_filed"), F.max("filed").cast("string").alias("last_filed"), F.count(F.lit(1)).alias("filings"))


@query
def warning_counts(spark, d):
    return read_parquet(spark, d, "cleaning_manifest").select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("filings"))


@query
def top_terms(spark, d):
    """The ten most frequent tokens of each ticker."""
    counted = inputs.chunk_texts(spark, d).select("ticker", F.explode(T.lexical_tokens(F.col("text"))).alias("term")).groupBy("ticker", "term").agg(F.count(F.lit(1)).alias("n"))
    return selection.top_rows(counted, ["ticker"], [F.desc("n"), F.asc("term")], 10)


# selection


@query
def distinct_filings(spark, d):
    return inputs.filings(spark, d).select("accession_number", "ticker", "filing_type", "filing_date", "source_url", "human_readable_warning")


@query
def latest_filings(spark, d):
    return selection.latest_filings(inputs.filings(spark, d), inputs.CUTOFF, COUNTS).select("ticker", "filing_type", "accession_number", "filing_date", "rank")


@query
def filing_policy(spark, d):
    return validation.filing_policy(inputs.filings(spark, d), ["ticker"], COUNTS, inputs.CUTOFF, F.col("filed"))


@query
def last_written(spark, d):
    return inputs.results(spark, d, "status").select("run_fingerprint", "qa_id", "retriever", "status", F.col("recorded_at").cast("string").alias("recorded_at"))


@query
def resume_worklist(spark, d):
    """Questions and retrievers of each run without an ok result."""
    r = read_parquet(spark, d, "eval_results")
    runs = r.select("run_fingerprint").distinct()
    asked = inputs.questions(spark, d).select("qa_id", "ticker").join(r.select("ticker", "run_fingerprint").withColumn("ticker", T.norm_ticker(F.col("ticker"))).distinct(), "ticker").join(runs, "run_fingerprint", "left_semi")
    return selection.open_work(asked.select("run_fingerprint", "qa_id"), ["bm25", "faiss"], r, ["run_fingerprint", "qa_id"], ["recorded_at"])


@query
def union_unique(spark, d):
    """Filings and cleaned filings united; keys that stand in both, or twice in one."""
    a = read_parquet(spark, d, "filings").select("accession_number", F.lit("filings").alias("t"))
    b = read_parquet(spark, d, "cleaning_manifest").select("accession_number", F.lit("manifest").alias("t"))
    return a.unionByName(b).groupBy("accession_number").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("t").alias("tables"))


@query
def manifest_gaps(spark, d):
    """Accession numbers of chunks that the manifest lacks."""
    return read_parquet(spark, d, "chunks").select("accession_number").distinct().join(read_parquet(spark, d, "cleaning_manifest"), "accession_number", "left_anti")


def _latest(spark, d):
    return selection.latest_filings(inputs.filings(spark, d), inputs.CUTOFF, COUNTS)


@query
def chunks_beyond_latest(spark, d):
    """Accession numbers of chunks of other filings than the latest."""
    return read_parquet(spark, d, "chunks").select("accession_number").distinct().join(_latest(spark, d).select("accession_number"), "accession_number", "left_anti")


@query
def set_operations(spark, d):
    c, f = (read_parquet(spark, d, t).select(T.norm_ticker(F.col("ticker")).alias("ticker"), "filing_type").distinct() for t in ("chunks", "filings"))
    both = c.intersect(f).withColumn("side", F.lit("both"))
    return both.unionByName(c.subtract(f).withColumn("side", F.lit("chunks"))).unionByName(f.subtract(c).withColumn("side", F.lit("filings")))


# retrieval


def _asked(spark, d):
    """query, part, question of the questions with a ticker; the forms they name, and whether each has a place."""
    q = inputs.questions(spark, d).where("ticker IS NOT NULL").select(F.col("qa_id").alias("query"), F.col("ticker").alias("part"), "question", T.form_mentions(F.col("question")).alias("forms"), T.compares(F.col("question")).alias("compares"))
    return q.withColumn("require_each", F.col("compares") & (F.size("forms") > 1))


def _bm25(spark, d, k, constrained=False, per_group=False):
    records = lexical.records_of(inputs.chunk_texts(spark, d, "filing_type"), "ticker", "chunk_id", "text", "filing_type")
    asked = _asked(spark, d).select("query", "part", "question", (F.col("forms") if constrained else F.array().cast("array<string>")).alias("allowed"))
    return lexical.best_of_index(records, lexical.terms_of(records), asked, k, per_group)


def _place():
    return F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key")))


@query
def bm25_topk(spark, d):
    return _bm25(spark, d, K).select(F.col("query").alias("qa_id"), F.col("key").alias("chunk_id"), "score", _place().alias("rank"))


@query
def bm25_term_stats(spark, d):
    terms = lexical.terms_of(lexical.records_of(inputs.chunk_texts(spark, d), "ticker", "chunk_id", "text"))
    return terms.select(F.col("part").alias("ticker"), "term", "df", "n", F.round("avgdl", 6).alias("avgdl"), F.round("idf", 6).alias("idf"))


def _forms_as_written(spark, d):
    return inputs.chunks(spark, d, "filing_type").select(F.col("chunk_id").alias("key"), "filing_type")


@query
def bm25_topk_filtered(spark, d):
    """The best chunks among the forms a question names."""
    best = _bm25(spark, d, K, constrained=True).join(_forms_as_written(spark, d), "key")
    return best.select(F.col("query").alias("qa_id"), F.col("key").alias("chunk_id"), "filing_type", "score", _place().alias("rank"))


@query
def bm25_topk_reserved(spark, d):
    """As filtered, with a place for each form that a comparing question names: the best k of each form hold every choice."""
    best = _bm25(spark, d, K, constrained=True, per_group=True).withColumn("rank", _place())
    chosen = selection.reserved_top_k(best.join(_asked(spark, d).select("query", "forms", "require_each"), "query"), "query", "grp", "rank", K, "forms", "require_each")
    return chosen.join(_forms_as_written(spark, d), "key").select(F.col("query").alias("qa_id"), F.col("key").alias("chunk_id"), "filing_type", "score", "place")


@query
def constraint_inference(spark, d):
    return _asked(spark, d).select(F.col("query").alias("qa_id"), F.array_join("forms", ",").alias("forms"), "compares", "require_each")


def _vectors(spark, d):
    e = read_parquet(spark, d, "embeddings")
    # the stated query set: every id divisible by 100
    return e, e.where("vec_id % 100 = 0").withColumn("wanted", F.array(F.pmod("label", F.lit(10)), F.pmod(F.col("label") + 1, F.lit(10))))


@query
def dense_topk(spark, d):
    e, q = _vectors(spark, d)
    return dense.dense_top_k(e, "vec_id", "embedding", q, "vec_id", "embedding", K)


@query
def dense_topk_filtered(spark, d):
    e, q = _vectors(spark, d)
    return dense.dense_top_k(e, "vec_id", "embedding", q, "vec_id", "embedding", K, group="label", allowed="wanted").withColumnRenamed("grp", "label")


@query
def dense_topk_reserved(spark, d):
    """A place for the best row of each wanted label."""
    e, q = _vectors(spark, d)
    best = dense.dense_top_k(e, "vec_id", "embedding", q, "vec_id", "embedding", K, group="label", allowed="wanted", per_group=True)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc("key"))))
    asked = q.select(F.col("vec_id").alias("query"), F.col("wanted").alias("forms"), F.lit(True).alias("require_each"))
    return selection.reserved_top_k(ranked.join(asked, "query"), "query", "grp", "rank", K, "forms", "require_each").select("query", "key", F.col("grp").alias("label"), "score", "place")


@query
def embedding_norms(spark, d):
    e = read_parquet(spark, d, "embeddings")
    return e.select("vec_id", F.round(T.dot(T.unit(F.col("embedding")), T.unit(F.col("embedding"))), 6).alias("unit_norm"), F.round(T.dot(F.col("embedding"), F.col("embedding")), 6).alias("norm"))


@query
def neighbour_cosine(spark, d):
    """Cosine of each vector with the one of the next id."""
    e = read_parquet(spark, d, "embeddings").select("vec_id", T.unit(F.col("embedding")).alias("v"))
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id").select("vec_id", F.round(T.dot(F.col("v"), F.col("w")), 6).alias("cosine"))


@query
def prompt_context(spark, d):
    """The retrieved chunks of each question as the context of a prompt."""
    c = inputs.chunks(spark, d, "filing_type", "filing_date", "section_heading", "text").select(F.col("chunk_id").alias("key"), "filing_type", "filing_date", F.coalesce("section_heading", F.lit("unknown")).alias("section_heading"), "text")
    return scoring.prompt_context(_bm25(spark, d, 2).withColumn("rank", _place()).join(c, "key"), "query").select(F.col("query").alias("qa_id"), F.length("context").alias("length"), F.md5("context").alias("context_md5"))


@query
def embedding_documents(spark, d):
    c = inputs.chunks(spark, d, "company", "ticker", "filing_type", "filing_date", "section_heading", "text").where("text IS NOT NULL")
    return c.select("chunk_id", F.md5(scoring.embedding_document()).alias("document_md5"))


# questions and scores


@query
def completed_answers(spark, d):
    return inputs.questions(spark, d).where(~T.is_missing(F.col("answer"))).select("qa_id", F.md5("answer").alias("answer_md5"))


@query
def eval_violations(spark, d):
    return validation.eval_violations(read_parquet(spark, d, "eval_set"))


@query
def chunk_violations(spark, d):
    return validation.chunk_violations(read_parquet(spark, d, "chunks"), 400, inputs.CUTOFF, T.parse_date(F.col("filing_date")))


@query
def result_violations(spark, d):
    return validation.result_violations(read_parquet(spark, d, "eval_results"), 2, ["bm25", "faiss"])


@query
def gold_referential(spark, d):
    docs = inputs.filings(spark, d).select(T.doc_id(F.col("ticker"), F.col("filing_type"), F.col("filing_date")).alias("doc_id"))
    return validation.missing_gold(inputs.questions(spark, d), docs)


@query
def gold_beyond_latest(spark, d):
    """Gold documents that are none of the latest filings."""
    docs = _latest(spark, d).select(T.doc_id(F.col("ticker"), F.col("filing_type"), F.col("filing_date")).alias("doc_id"))
    return validation.missing_gold(inputs.questions(spark, d), docs)


@query
def coverage_matrix(spark, d):
    """2: several documents asked for, 1: answered, 0: open; of each ticker and question the greatest."""
    state = F.when(F.col("source_doc_id").endswith("_MULTI"), 2).when(~T.is_missing(F.col("answer")), 1).otherwise(0)
    return inputs.questions(spark, d).groupBy("ticker", "question_id").agg(F.max(state).alias("state"))


@query
def retrieval_metrics(spark, d):
    return inputs.scored(spark, d).select("run_fingerprint", "qa_id", "retriever", "document_recall_at_k", "document_reciprocal_rank", "chunk_recall_at_k", "chunk_reciprocal_rank")


@query
def token_f1(spark, d):
    return inputs.scored(spark, d).select("run_fingerprint", "qa_id", "retriever", "word_overlap_f1")


@query
def status_derivation(spark, d):
    r = inputs.results(spark, d, "retrieval_status", "generation_status", "status")
    return r.groupBy("retrieval_status", "generation_status", "status", scoring.overall_status(F.col("retrieval_status"), F.col("generation_status")).alias("derived")).agg(F.count(F.lit(1)).alias("n"))


@query
def metric_means(spark, d):
    scored = inputs.scored(spark, d).withColumn("category_label", F.element_at(F.create_map(*[F.lit(x) for kv in T.CATEGORY_LABELS.items() for x in kv]), F.col("category")))
    return profile.metric_means(scored, [["retriever"], ["ticker", "retriever"], ["category_label", "retriever"], ["answerable", "retriever"]])


@query
def category_means(spark, d):
    """Means by category and retriever, of all categories."""
    return profile.means_over(inputs.scored(spark, d), {"category": list(T.CATEGORY_LABELS), "retriever": ["bm25", "faiss"]})


@query
def answerable_means(spark, d):
    return profile.means_over(inputs.scored(spark, d), {"answerable": [True, False], "retriever": ["bm25", "faiss"]})


@query
def metric_availability(spark, d):
    return profile.availability(inputs.scored(spark, d), ["retriever"])


@query
def outcome_counts(spark, d):
    return profile.outcomes(inputs.results(spark, d, "status"), ["retriever"])


@query
def metric_correlations(spark, d):
    return profile.correlations(inputs.scored(spark, d), ["retriever"], ["document_recall_at_k", "document_reciprocal_rank", "chunk_recall_at_k", "chunk_reciprocal_rank", "word_overlap_f1"])


@query
def box_stats(spark, d):
    return profile.box_stats(profile.long_metrics(inputs.scored(spark, d), ["retriever"]), ["retriever", "metric"], "value")


def _deltas(spark, d):
    return profile.paired_deltas(inputs.scored(spark, d), ["run_fingerprint", "qa_id", "category"]).withColumn("question", F.concat_ws("/", "run_fingerprint", "qa_id"))


@query
def paired_deltas(spark, d):
    return _deltas(spark, d).select("run_fingerprint", "qa_id", "metric", "delta")


@query
def delta_extremes(spark, d):
    return profile.delta_extremes(_deltas(spark, d), "question")


@query
def category_deltas(spark, d):
    return profile.category_deltas(_deltas(spark, d), "category")


# what is written and read again


def _scratch(spark):
    return f"{ensure_checkpoint_dir(spark)}/round-trip-{uuid.uuid4().hex}"


@query
def csv_round_trip(spark, d):
    """The questions as CSV, with the line breaks and quotes of their texts."""
    path, blank = _scratch(spark), lambda c: F.nullif(F.col(c), F.lit(""))
    q = inputs.questions(spark, d).drop("ticker").join(read_parquet(spark, d, "eval_set").select("qa_id", "ticker").distinct(), "qa_id").withColumn("answerable", F.col("answerable").cast("string"))
    columns = [f.split()[0] for f in tables.QUESTION.split(", ")]
    tables.write_csv(q, path, columns, ["qa_id"])
    read = tables.read_csv(spark, path, tables.QUESTION, tables.csv_encoding(spark, path))
    return read.select("qa_id", "question_id", F.md5("question").alias("question_md5"), F.md5(blank("answer")).alias("answer_md5"), blank("ticker").alias("ticker"), "category", blank("answerable").alias("answerable"), blank("source_doc_ids").alias("source_doc_ids"))


@query
def jsonl_round_trip(spark, d):
    """The chunks as JSON lines in order."""
    path = _scratch(spark)
    columns = [f.split()[0] for f in tables.CHUNK.split(", ")]
    tables.write_jsonl(inputs.chunks(spark, d), path, columns, ["accession_number", "chunk_index", "chunk_id"])
    return tables.read_jsonl(spark, path, tables.CHUNK).select("chunk_id", "chunk_index", F.md5("text").alias("text_md5"), "section_heading", "cik", "word_count")


@query
def log_round_trip(spark, d):
    """The results appended to a log in two commits and read back, the last of each pair."""
    path = _scratch(spark)
    r = read_parquet(spark, d, "eval_results")
    schema = tables.RESULT + ", recorded_at timestamp_ntz"
    columns = [f.split()[0] for f in schema.split(", ")]
    for half in (0, 1):
        tables.append_checkpoint(r.where(F.pmod(F.xxhash64("qa_id", "recorded_at"), F.lit(2)) == half).select(*columns), path)
    last = selection.last_written(tables.read_checkpoint(spark, path, schema).select(*columns), ["run_fingerprint", "qa_id", "retriever"], ["recorded_at"])
    return last.select("run_fingerprint", "qa_id", "retriever", "status", F.md5("llm_answer").alias("answer_md5"))


# scalar functions


@query
def pipe_lists(spark, d):
    return inputs.results(spark, d).select("run_fingerprint", "qa_id", "retriever", F.size(T.pipe_list(F.col("retrieved_chunk_ids"))).alias("chunks"), F.array_join(F.array_distinct(T.pipe_list(F.col("retrieved_doc_ids"))), ";").alias("docs"), F.round(F.aggregate(F.transform(T.pipe_list(F.col("retrieval_scores")), lambda x: F.try_to_number(x, F.lit("999999.999999")).cast("double")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0))), 4).alias("score_sum"))


@query
def identifiers(spark, d):
    c = inputs.chunks(spark, d, "cik", "ticker", "accession_number", "chunk_index", "filing_type", "filing_date", "company")
    return c.select("chunk_id", T.pad_cik(F.col("cik")).alias("cik10"), T.chunk_id(F.col("ticker"), F.col("accession_number"), F.col("chunk_index")).alias("made_id"), T.doc_id(F.col("ticker"), F.col("filing_type"), F.col("filing_date")).alias("doc_id"), T.safe_name(F.col("company")).alias("file_name"), T.parse_date(F.col("filing_date")).cast("string").alias("filed"))


@query
def scoring_tokens(spark, d):
    r = inputs.results(spark, d)
    return r.select("run_fingerprint", "qa_id", "retriever", F.size(T.scoring_tokens(F.col("llm_answer"))).alias("tokens"))


@query
def row_fingerprints(spark, d):
    c = inputs.chunks(spark, d, "text")
    return c.select("chunk_id", F.sha2(F.concat_ws("\u001f", "chunk_id", F.coalesce("text", F.lit(""))), 256).alias("sha256"))


@query
def sequence_fingerprints(spark, d):
    """The ids of each filing in order, as one hash."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda s: s["chunk_id"]), "|")
    return inputs.chunks(spark, d, "accession_number", "chunk_index").groupBy("accession_number").agg(F.sha2(ordered, 256).alias("sha256"), F.count(F.lit(1)).alias("chunks"))


# cleaning


def _texts(spark, d):
    return spread(read_parquet(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))


@query
def normal_lines(spark, d):
    t = _texts(spark, d)
    lines = F.array_join(cleaning.normal_lines(F.col("text")), "\n")
    return t.select("doc_id", F.md5(lines).alias("lines_md5"), F.size(cleaning.normal_lines(F.col("text"))).alias("lines"))


@query
def item_headings(spark, d):
    """Headings of chunks in their display form."""
    h = read_parquet(spark, d, "chunks").where("section_heading IS NOT NULL").select("section_heading").distinct().withColumn("line", T.squeeze(F.col("section_heading")))
    return h.select("section_heading", cleaning.item_number(F.col("line")).alias("number"), cleaning.item_heading(F.col("line")).alias("heading"))


@query
def clean_documents(spark, d):
    """Every document cleaned as HTML, cut into sections and windows."""
    docs = spread(read_parquet(spark, d, "documents").select("doc_id", "text", F.lit("html").alias("fmt")))
    cleaned = cleaning.clean_documents(docs, "text", "fmt")
    return cleaned.select("doc_id", F.md5("cleaned_text").alias("cleaned_md5"), "raw_length", "cleaned_length", F.array_join("warnings", ",").alias("warnings"))


@query
def quality_warnings(spark, d):
    """Warnings of documents taken as plain text."""
    t = _texts(spark, d).withColumn("n", F.length("text"))
    return t.select("doc_id", F.array_join(cleaning.quality_warnings(F.col("text"), F.col("n"), F.col("n"), F.contains(F.lower("text"), F.lit("<table"))), ",").alias("warnings"))


@query
def section_windows(spark, d):
    """Filings put together from their chunks, cleaned, cut into sections and windows again."""
    whole = inputs.chunks(spark, d, "accession_number", "ticker", "chunk_index", "section_heading", "text").where("text IS NOT NULL").groupBy("accession_number").agg(F.min("ticker").alias("ticker"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.concat(F.lit("## "), F.coalesce(F.nullif(T.squeeze(F.col("section_heading")), F.lit("")), F.lit("unknown")), F.lit("\n"), F.col("text")).alias("t")))), lambda s: s["t"]), "\n").alias("whole"))
    out = chunking.chunk_texts(whole, "whole")
    return out.select("accession_number", "chunk_index", "chunk_id", "section_heading", "word_count", F.md5("text").alias("text_md5"))


ORACLE = {k: v for k, v in _SQL.items() if k in QUERIES}
