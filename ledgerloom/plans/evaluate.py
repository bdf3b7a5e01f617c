"""The evaluate stage: retrieval and answers for questions, kept attempt by attempt; a run goes on where it stopped, and only as the run it was."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions import text as T
from ledgerloom.functions.providers import apply_provider
from ledgerloom.operators import dense, lexical, scoring, selection, validation
from ledgerloom.session import cut_lineage
from ledgerloom.sources import index_store, publish, tables
from ledgerloom.sources.files import Files

VERSION, POLICY = 2, 1
SCHEMA = tables.RESULT + ", attempt long"
COLUMNS = [f.split()[0] for f in tables.RESULT.split(", ")]
#: Questions and retrievers that are answered and committed together.
BATCH = 500
SYSTEM = "Answer from the context alone and name the chunks used. If the context does not hold the answer, say so."


def bm25_index(spark: SparkSession, chunks: DataFrame, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(records, terms, fingerprint) of the kept index of ``chunks``, built where it is missing or of other chunks."""
    about = lexical.source_fingerprint(chunks, "ticker", "chunk_id", "text", "filing_type")
    try:
        records, terms = lexical.load_index(spark, path, about)
    except index_store.StaleIndexError:
        lexical.build_index(chunks, "ticker", "chunk_id", "text", path, "filing_type")
        records, terms = lexical.load_index(spark, path, about)
    return records, terms, json.loads(Files(spark).read(f"{path}/manifest.json"))["index_fingerprint"]


def dense_index(spark: SparkSession, chunks: DataFrame, path: str, model: str, embed) -> tuple[DataFrame, str]:
    """(vectors, fingerprint) likewise; chunks are embedded only where the index is built."""
    about = lexical.source_fingerprint(chunks, "ticker", "chunk_id", "text", "filing_type")
    try:
        vectors = dense.load_index(spark, path, model, about)
    except index_store.StaleIndexError:
        if embed is None:
            raise
        embedded = cut_lineage(apply_provider(chunks.withColumn("__d", scoring.embedding_document()), "__d", "vector", "array<float>", embed))
        dense.build_index(embedded, "ticker", "chunk_id", "vector", path, model, about, "filing_type")
        vectors = dense.load_index(spark, path, model, about)
    return vectors, json.loads(Files(spark).read(f"{path}/manifest.json"))["index_fingerprint"]


def retrieve(asked: DataFrame, chunks: DataFrame, retrievers: list[str], k: int, bm25=None, vectors: DataFrame | None = None, embed=None) -> DataFrame:
    """qa_id, retriever, place, chunk_id, score of the best ``k`` chunks: all chunks of the forms a question names are ranked, and a comparing question has a place for each form.

    ``asked``: qa_id, ticker, question, retriever.
    """
    forms = T.form_mentions(F.col("question"))
    named = asked.withColumns({"ticker": T.norm_ticker(F.col("ticker")), "forms": forms}).withColumn("each", T.compares(F.col("question")) & (F.size("forms") > 1))
    found = []
    if bm25 and "bm25" in retrievers:
        mine = named.where("retriever = 'bm25'").select(F.col("qa_id").alias("query"), F.col("ticker").alias("part"), "question", F.col("forms").alias("allowed"))
        best = lexical.best_of_index(*bm25, mine, k, per_group=True)
        found.append(best.select(F.col("query").alias("qa_id"), F.lit("bm25").alias("retriever"), "key", "grp", "score"))
    if vectors is not None and "faiss" in retrievers:
        part = lambda form: F.concat_ws("|", "ticker", F.upper(F.trim(form)))
        kinds = chunks.select(T.norm_ticker(F.col("ticker")).alias("ticker"), F.upper(F.trim("filing_type")).alias("f")).groupBy("ticker").agg(F.collect_set("f").alias("kinds"))
        mine = apply_provider(named.where("retriever = 'faiss'"), "question", "vector", "array<float>", embed).join(kinds, "ticker", "left")
        own = F.transform(F.when(F.size("forms") > 0, F.col("forms")).otherwise(F.coalesce("kinds", F.array().cast("array<string>"))), part)
        rows = vectors.select("key", F.concat_ws("|", T.norm_ticker(F.col("part")), F.upper(F.trim("grp"))).alias("grp"), "vector")
        # the best k of each form of the ticker hold the best k of any choice of forms
        hits = dense.dense_top_k(rows, "key", "vector", mine.withColumn("own", own).where(F.size("own") > 0), "qa_id", "vector", k, group="grp", allowed="own", per_group=True)
        found.append(hits.select(F.col("query").alias("qa_id"), F.lit("faiss").alias("retriever"), "key", F.substring_index("grp", "|", -1).alias("grp"), "score"))
    if not found:
        return asked.sparkSession.createDataFrame([], "qa_id string, retriever string, place int, chunk_id string, score double")
    pair = F.concat_ws("|", "qa_id", "retriever")
    every = reduce(DataFrame.unionByName, found).join(named.select("qa_id", "retriever", "forms", "each"), ["qa_id", "retriever"]).withColumn("pair", pair)
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("score"), F.asc("key"))))
    return selection.reserved_top_k(ranked, "pair", "grp", "rank", k, "forms", "each").select("qa_id", "retriever", "place", F.col("key").alias("chunk_id"), "score")


def run_settings(questions: DataFrame, retrievers: list[str], k: int, llm_model: str, indexes: dict[str, str], include_incomplete: bool) -> dict:
    """What makes a run the run it is; its hash is the run's fingerprint."""
    rows = questions.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*sorted(questions.columns)).cast("decimal(38,0)")).alias("h")).first()
    return {"schema_version": VERSION, "retrieval_policy_version": POLICY, "retrievers": sorted(retrievers), "retrieval_k": k, "llm_model": llm_model, "include_incomplete": include_incomplete, "questions": rows.n, "questions_hash": str(rows.h), "system_prompt": publish.fingerprint(SYSTEM), "indexes": indexes}


def results_of(spark: SparkSession, run: str) -> DataFrame:
    """The last result of each pair in a run's log."""
    log = tables.read_checkpoint(spark, f"{run}/log", SCHEMA)
    return selection.last_written(log.select(*COLUMNS, "attempt"), ["run_fingerprint", "qa_id", "retriever"], ["attempt"]).drop("attempt")


def evaluate(spark: SparkSession, questions: DataFrame, chunks: DataFrame, run: str, retrievers: list[str], k: int = 5, answer=None, embed=None, llm_model: str = "none", embedding_model: str = "none", tickers: list[str] | None = None, include_incomplete: bool = False, resume: bool = False, indexes: str | None = None, documents: DataFrame | None = None, batch: int = BATCH) -> DataFrame:
    """Retrieves and answers for each question and retriever without an ok result in the log of ``run``, and returns the last result of each pair.

    ``run`` is a folder: manifest.json, written first; log, one file or more a
    batch of ``batch`` pairs, committed as it is answered; results, the last
    results in order, written at the end, also where a batch fails. A run there
    is refused unless ``resume``, and then unless its questions, settings and
    indexes are those it began with. Questions without an answer are left out
    unless ``include_incomplete``; gold documents that are not among
    ``documents`` (doc_id) raise an error. Indexes are kept in ``indexes`` (in
    the run, where none is given) and used again while they are of ``chunks``.

    ``answer`` and ``embed`` are providers (``functions/providers.py``). Without
    ``answer`` generation is an error that says so; without ``embed`` dense
    retrieval is, unless an index is there and no question is left.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    files = Files(spark)
    if not resume:
        publish.refuse_existing(spark, f"{run}/manifest.json", f"{run}/log", f"{run}/results")
    elif not files.exists(f"{run}/manifest.json"):
        raise FileNotFoundError("the run to resume has no manifest")
    asked = questions.withColumn("ticker", T.norm_ticker(F.col("ticker")))
    if tickers:
        asked = asked.where(F.col("ticker").isin(validation.normalize_tickers(tickers)))
    if not include_incomplete:
        asked = asked.where(~T.is_missing(F.col("answer")))
    asked = cut_lineage(asked)
    validation.assert_clean(validation.eval_violations(asked).where("metric <> 'answer_missing'"))
    if asked.isEmpty():
        raise ValueError("no questions to evaluate")
    if documents is not None:
        missing = validation.missing_gold(asked, documents).orderBy("qa_id", "doc_id").limit(20).collect()
        if missing:
            raise ValueError("gold documents that are missing: " + ", ".join(f"{r.qa_id} {r.doc_id}" for r in missing))
    chunks = chunks.withColumn("ticker", T.norm_ticker(F.col("ticker")))
    where, known, bm25, vectors, lost = indexes or f"{run}/indexes", {}, None, None, {}
    if "bm25" in retrievers:
        records, terms, known["bm25"] = bm25_index(spark, chunks, f"{where}/bm25")
        bm25 = (records, terms)
    if "faiss" in retrievers:
        try:
            if embed is None:
                raise index_store.StaleIndexError("no embedding provider")
            vectors, known["faiss"] = dense_index(spark, chunks, f"{where}/dense", embedding_model, embed)
        except (index_store.StaleIndexError, ValueError) as e:
            lost["faiss"] = str(e)[:160]
            # an index that isn't there yet doesn't make another run
            known["faiss"] = embedding_model
    known = {r: publish.fingerprint([v if r != "faiss" else embedding_model, lexical.source_fingerprint(chunks, "ticker", "chunk_id", "text", "filing_type")]) for r, v in known.items()}
    settings = run_settings(asked, retrievers, k, llm_model, known, include_incomplete)
    fingerprint = publish.fingerprint(settings)
    if resume:
        said = json.loads(files.read(f"{run}/manifest.json"))
        if said.get("run_fingerprint") != fingerprint:
            differ = sorted(c for c, v in settings.items() if said.get(c) != v)
            raise ValueError(f"another run than the one that began here, by its {', '.join(differ) or 'fingerprint'}")
        before = tables.repair_log(spark, f"{run}/log", SCHEMA).select(*COLUMNS, "attempt") if files.exists(f"{run}/log") else spark.createDataFrame([], SCHEMA)
        before = cut_lineage(before)
    else:
        files.write(f"{run}/manifest.json", json.dumps(settings | {"run_fingerprint": fingerprint}, indent=2, sort_keys=True))
        before = spark.createDataFrame([], SCHEMA)
    work = cut_lineage(selection.open_work(asked, retrievers, before, ["qa_id"], ["attempt"]))
    attempt = (before.agg(F.max("attempt").alias("a")).first().a or 0) + 1
    try:
        total = work.count()
        if total:
            hits = cut_lineage(retrieve(work.select("qa_id", "ticker", "question", "retriever"), chunks, retrievers, k, bm25, vectors, embed))
            about = chunks.select("chunk_id", "filing_type", "filing_date", "section_heading", "text", F.col("ticker").alias("t"))
            chosen = cut_lineage(hits.join(about, "chunk_id").withColumn("rank", F.col("place")).withColumn("pair", F.concat_ws("|", "qa_id", "retriever")))
            batches = -(-total // batch)
            # a batch is about ``batch`` pairs, by hash, so that no order of all is needed
            numbered = work.withColumn("pair", F.concat_ws("|", "qa_id", "retriever")).withColumn("__b", F.pmod(F.xxhash64("pair"), F.lit(batches)))
            for b in range(batches):
                rows = _answered(numbered.where(F.col("__b") == b).drop("__b"), chosen, answer, lost, fingerprint, k, llm_model, attempt + b)
                tables.append_checkpoint(rows, f"{run}/log")
    finally:
        if files.exists(f"{run}/log"):
            last = results_of(spark, run)
            staged = f"{run}/_results.staged"
            files.delete(staged)
            tables.write_csv(last, staged, COLUMNS, ["retriever", "qa_id"])
            publish.publish(spark, {staged: f"{run}/results"})
    return results_of(spark, run)


def _answered(work: DataFrame, chosen: DataFrame, answer, lost: dict[str, str], fingerprint: str, k: int, llm_model: str, attempt: int) -> DataFrame:
    """The rows of the log for the pairs of ``work``."""
    pairs = work.select("pair")
    mine = chosen.join(pairs, "pair", "left_semi")
    listed = mine.withColumn("doc", T.doc_id(F.col("t"), F.col("filing_type"), F.col("filing_date"))).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc", F.format_string("%.6f", "score").alias("score"), F.coalesce("section_heading", F.lit("")).alias("section_heading"), F.coalesce("filing_date", F.lit("")).alias("filing_date")))).alias("h"))
    rows = work.join(listed, "pair", "left").join(scoring.prompt_context(mine, "pair"), "pair", "left")
    reason = F.when(F.col("h").isNull(), F.coalesce(*[F.when(F.col("retriever") == r, F.lit(e)) for r, e in lost.items()], F.lit("no chunks were found")))
    rows = rows.withColumn("retrieval_error", reason).withColumn("__p", F.when(F.col("h").isNotNull(), F.concat(F.lit(f"{SYSTEM}\n\nQuestion: "), "question", F.lit("\n\nContext:\n"), F.coalesce("context", F.lit("")))))
    answered = apply_provider(rows, "__p", "llm_answer", "string", answer)
    joined = lambda f: F.coalesce(F.array_join(F.transform("h", lambda x: x[f]), "|"), F.lit(""))
    retrieval = F.when(F.col("h").isNull(), "error").otherwise("ok")
    blank = F.when((F.col("llm_answer_status") == "ok") & T.is_missing(F.col("llm_answer")), F.lit("the answer has no text"))
    generation = F.when(F.col("h").isNull(), "not_run").when((F.col("llm_answer_status") == "ok") & blank.isNull(), "ok").otherwise("error")
    single = T.strip(F.coalesce("source_doc_id", F.lit("")))
    many = T.strip(F.coalesce("source_doc_ids", F.lit("")))
    optional = lambda c: F.col(c).cast("string") if c in work.columns else F.lit(None).cast("string")
    gold_chunks = F.coalesce(optional("source_chunk_ids"), optional("source_chunk_id"))
    return answered.select(
        F.lit(VERSION).alias("schema_version"), F.lit(fingerprint).alias("run_fingerprint"), "qa_id", "ticker", F.col("question_id").cast("int"), F.col("category").cast("int"), T.parse_boolean(F.col("answerable")).alias("answerable"), "question",
        F.col("answer").alias("ground_truth"), single.alias("source_doc_id"), F.when((many == "") & ~single.endswith("_MULTI"), single).otherwise(many).alias("source_doc_ids"), gold_chunks.alias("source_chunk_ids"), "llm_answer",
        joined("chunk_id").alias("retrieved_chunk_ids"), joined("doc").alias("retrieved_doc_ids"), joined("score").alias("retrieval_scores"), joined("section_heading").alias("retrieved_sections"), joined("filing_date").alias("retrieved_filing_dates"), F.lit(k).alias("retrieval_k"), "retriever", F.lit(llm_model).alias("llm_model"),
        retrieval.alias("retrieval_status"), "retrieval_error", generation.alias("generation_status"), F.when(generation == "error", F.coalesce(blank, "llm_answer_error", F.lit("no answer provider"))).alias("generation_error"),
        scoring.overall_status(retrieval, generation).alias("status"), F.lit(attempt).cast("long").alias("attempt"),
    )


JUDGE = "Question: {q}\n\nReference answer: {r}\n\nGiven answer: {a}\n\nHow well do the facts of the given answer agree with the reference? Reply with one digit from 1 (not at all) to 5 (fully)."


def score(results: DataFrame, out: str, embed=None, judge=None, retrievers: list[str] | None = None, overwrite: bool = False) -> DataFrame:
    """Validates results, writes them with their metrics as parquet, and returns the means by retriever, ticker, category and answerability.

    With ``embed``, the cosine of answer and reference is scored; with ``judge``,
    its marks are, and ``llm_judge_error`` says where one is missing. Results of
    several runs raise an error; scores there are kept unless ``overwrite``.
    """
    from ledgerloom.operators import profile

    spark = results.sparkSession
    if not overwrite:
        publish.refuse_existing(spark, out)
    results = cut_lineage(results)
    validation.require_columns(results, set(COLUMNS))
    report = validation.result_violations(results, VERSION, ["bm25", "faiss"]).where("metric IN ('duplicate_pair', 'status_inconsistent', 'schema_version_wrong', 'retriever_unknown', 'k_below_one', 'category_out_of_range', 'answerable_missing', 'fingerprint_missing')")
    validation.assert_clean(report)
    if results.select("run_fingerprint").distinct().limit(2).count() > 1:
        raise ValueError("results of several runs")
    if retrievers:
        results = results.where(F.col("retriever").isin(retrievers))
    eligible = (F.col("generation_status") == "ok") & ~T.is_missing(F.col("ground_truth"))
    rows, vectors, said = results, (None, None), None
    if embed is not None:
        for c, v in (("llm_answer", "__a"), ("ground_truth", "__g")):
            rows = apply_provider(rows.withColumn(f"{v}t", F.when(eligible, F.col(c))), f"{v}t", v, "array<float>", embed, batch=100).drop(f"{v}t", f"{v}_status", f"{v}_error")
        vectors = ("__a", "__g")
    if judge is not None:
        parts = F.replace(F.replace(F.replace(F.lit(JUDGE), F.lit("{q}"), F.coalesce("question", F.lit(""))), F.lit("{r}"), F.coalesce("ground_truth", F.lit(""))), F.lit("{a}"), F.coalesce("llm_answer", F.lit("")))
        rows = apply_provider(rows.withColumn("__j", F.when(eligible, parts)), "__j", "__said", "string", judge).drop("__j", "__said_status")
        said = "__said"
    rows = cut_lineage(rows)
    if vectors[0]:
        dense.vector_length((rows, "__a"), (rows, "__g"))
    scored = scoring.score_results(rows, *vectors, said)
    wrong = F.when(eligible & F.col("llm_score").isNull(), F.coalesce(F.col("__said_error"), F.concat(F.lit("not a mark: "), F.left(F.coalesce("__said", F.lit("")), F.lit(80))))) if judge is not None else F.lit(None).cast("string")
    scored = scored.withColumn("llm_judge_error", wrong).drop("__a", "__g", "__said", "__said_error")
    staged = f"{out.rstrip('/')}.staged"
    Files(spark).delete(staged)
    scored.write.parquet(staged)
    publish.publish(spark, {staged: out})
    labelled = spark.read.parquet(out).withColumn("category_label", F.element_at(F.create_map(*[F.lit(x) for kv in T.CATEGORY_LABELS.items() for x in kv]), F.col("category")))
    return profile.metric_means(labelled, [["retriever"], ["ticker", "retriever"], ["category_label", "retriever"], ["answerable", "retriever"]])
