"""The stages after each other on two small filings."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.plans import pipeline
from ledgerloom.sources import tables


def test_build_describe_evaluate_score(spark, tmp_path):
    filings = spark.createDataFrame(
        [("Co", "AA", "0001", "10-K", "2025-01-01", "1", "u", "a.html", "html", "", "", ""), ("Co", "aa ", "0001", "10-K", "2024-01-01", "2", "u", "old", "text", "", "", ""), ("Co", "AA", "0001", "8-K", "2025-02-01", "3", "u", "b.txt", "text", "", "", ""), ("Co", "AA", "0001", "8-K", "2027-02-01", "4", "u", "late", "text", "", "", "")],
        tables.FILING,
    )
    body = " ".join(f"word{i}" for i in range(900))
    raw = spark.createDataFrame([("a.html", f"<h1>Item 1. Business</h1><p>cash rises {body}</p>"), ("b.txt", "Item 8.01\nOther Events\nthe board met about cash"), ("old", "x"), ("late", "y")], "local_raw_path string, content string")
    out = str(tmp_path / "data")
    manifest = pipeline.build_dataset(spark, filings, raw, out, "2026-07-14", {"10-K": 1, "8-K": 1})
    chunks = spark.read.parquet(f"{out}/chunks.parquet")
    assert manifest["chunks"] == chunks.count() == 4
    assert {(r.accession_number, r.section_heading) for r in chunks.collect()} == {("1", "Item 1. Business"), ("3", "Item 8.01. Other Events")}
    report = str(tmp_path / "report")
    assert "Chunks by ticker" in pipeline.describe(spark, out, report) and pipeline.is_fresh(spark, out, report)
    # the published dataset is used again while it is whole and of these settings
    counts = {"10-K": 1, "8-K": 1}
    assert pipeline.is_current(spark, out, "2026-07-14", counts) and not pipeline.is_current(spark, out, "2026-07-14", counts, 300) and not pipeline.is_current(spark, out, "2024-07-14", counts) and not pipeline.is_current(spark, out, "2026-07-14", counts, tickers=["aa"])
    (tmp_path / "data" / "stray").write_text("x")
    assert [p for p in pipeline.prune_dataset(spark, out) if not p.endswith(".crc")] == ["stray"] and pipeline.is_current(spark, out, "2026-07-14", counts)
    assert tables.read_csv(spark, f"{out}/chunks.csv", tables.CHUNK).count() == tables.read_jsonl(spark, f"{out}/chunks.jsonl", tables.CHUNK).count() == 4
    with pytest.raises(ValueError, match="do not meet"):
        pipeline.build_dataset(spark, filings, raw, out, "2026-07-14", {"10-K": 1, "10-Q": 1}, complete=True)
    with pytest.raises(Exception, match="no contents of filing 3"):
        pipeline.build_dataset(spark, filings, raw.where("local_raw_path <> 'b.txt'"), out, "2026-07-14", counts)
    assert pipeline.is_current(spark, out, "2026-07-14", counts)  # the former dataset stays
    questions = spark.createDataFrame([("q1", 1, "What about cash in the 8-K?", "it met", "aa", 1, "true", "AA_8-K_2025-02-01", None), ("q2", 2, "Compare cash in the 10-K and 8-K", "both", "AA", 2, "yes", "AA_MULTI", None), ("q3", 3, "Open", None, "AA", 2, "yes", "AA_MULTI", None)], tables.QUESTION)
    run, both = str(tmp_path / "run"), ["bm25", "faiss"]
    embed = lambda ts: [[float("cash" in t), float(len(t) % 7), 1.0] for t in ts]
    first = {(r.qa_id, r.retriever): r for r in pipeline.evaluate(spark, questions, chunks, run, both, 2, batch=1).collect()}
    assert set(first) == {(q, r) for q in ("q1", "q2") for r in both}
    assert first["q1", "bm25"].status == "generation_error" and first["q1", "bm25"].retrieved_doc_ids == "AA_8-K_2025-02-01" and first["q1", "faiss"].status == "retrieval_error"
    assert set(first["q2", "bm25"].retrieved_doc_ids.split("|")) == {"AA_8-K_2025-02-01", "AA_10-K_2025-01-01"} and first["q1", "bm25"].source_doc_ids == "AA_8-K_2025-02-01"
    with pytest.raises(FileExistsError):
        pipeline.evaluate(spark, questions, chunks, run, both, 2)
    with pytest.raises(ValueError, match="another run .* retrieval_k"):
        pipeline.evaluate(spark, questions, chunks, run, both, 3, resume=True)
    with pytest.raises(ValueError, match="another run .* indexes"):
        pipeline.evaluate(spark, questions, chunks.withColumn("text", F.concat("text", F.lit(" more"))), run, both, 2, resume=True)
    second = pipeline.evaluate(spark, questions, chunks, run, both, 2, answer=lambda ts: ["it met"] * len(ts), embed=embed, resume=True)
    assert {r.status for r in second.collect()} == {"ok"}
    rows = spark.read.json(f"{run}/log").count()
    assert rows == 8  # an attempt each
    pipeline.evaluate(spark, questions, chunks, run, both, 2, answer=lambda ts: ["other"] * len(ts), embed=embed, resume=True)
    assert spark.read.json(f"{run}/log").count() == rows  # all work was done
    results = pipeline.results_of(spark, run)
    assert tables.read_csv(spark, f"{run}/results", tables.RESULT).count() == results.count() == 4
    means = pipeline.score(results, str(tmp_path / "scored"), embed=embed, judge=lambda ts: ["4." if "it met\n\nGiven" in t else "Score: 5" for t in ts])
    row = means.where("grouping = 'ticker+retriever' AND retriever = 'bm25'").first()
    assert row.word_overlap_f1 == 0.5 and row.document_recall_at_k == 1.0 and row.cosine_sim <= 1.0 and row.llm_score == 4.0
    scored = {(r.qa_id, r.retriever): r for r in spark.read.parquet(str(tmp_path / "scored")).collect()}
    assert scored["q1", "bm25"].llm_judge_error is None and scored["q2", "bm25"].llm_score is None and "Score: 5" in scored["q2", "bm25"].llm_judge_error
    made = pipeline.figures(questions, spark.read.parquet(f"{out}/cleaning_manifest.parquet"), spark.read.parquet(str(tmp_path / "scored")))
    (tmp_path / "figures" / "old.csv").mkdir(parents=True)
    said = pipeline.write_figures(spark, made | {"none": lambda: questions.limit(0), "broken": lambda: questions.select("nothing")}, str(tmp_path / "figures"))
    assert said.pop("none") == "empty" and "nothing" in said.pop("broken") and set(said.values()) == {"written"} and not (tmp_path / "figures" / "old.csv").exists()
    means = spark.read.option("header", True).csv(str(tmp_path / "figures" / "category_means.csv"))
    assert means.count() == 8 and means.where("n = 0").count() == 4
    with pytest.raises(FileExistsError):
        pipeline.score(results, str(tmp_path / "scored"))
    assert pipeline.score(results, str(tmp_path / "scored"), retrievers=["bm25"], overwrite=True).where("grouping = 'retriever'").count() == 1
    with pytest.raises(ValueError, match="several runs"):
        pipeline.score(results.unionByName(results.withColumn("run_fingerprint", F.lit("x"))), str(tmp_path / "other"))
    assert chunks.where(F.col("word_count") > 400).count() == 0


def test_interrupted_run_keeps_its_answers(spark, tmp_path):
    chunks = spark.createDataFrame([("AA", "c1", "10-K", "2025-01-01", "h", "cash rises"), ("AA", "c2", "8-K", "2025-02-01", "h", "board met")], "ticker string, chunk_id string, filing_type string, filing_date string, section_heading string, text string")
    questions = spark.createDataFrame([(f"q{i}", i, f"What of cash {i}?", "a", "AA", 1, "true", "AA_MULTI", None) for i in range(6)], tables.QUESTION)
    run, calls = str(tmp_path / "run"), []

    before = tables.append_checkpoint

    def append(rows, log):
        if calls:
            raise KeyboardInterrupt  # the second batch is cut short
        calls.append(1)
        before(rows, log)

    tables.append_checkpoint = append
    try:
        with pytest.raises(KeyboardInterrupt):
            pipeline.evaluate(spark, questions, chunks, run, ["bm25"], 1, answer=lambda ts: ["x"] * len(ts), batch=2)
    finally:
        tables.append_checkpoint = before
    kept = pipeline.results_of(spark, run).count()
    assert 0 < kept < 6 and tables.read_csv(spark, f"{run}/results", tables.RESULT).count() == kept
    done = pipeline.evaluate(spark, questions, chunks, run, ["bm25"], 1, answer=lambda ts: ["y"] * len(ts), batch=2, resume=True).collect()
    assert len(done) == 6 and sum(r.llm_answer == "x" for r in done) == kept
    # a missing gold document stops a run before anything is asked
    with pytest.raises(ValueError, match="gold documents"):
        pipeline.evaluate(spark, questions.withColumn("source_doc_ids", F.lit("none")), chunks, str(tmp_path / "other"), ["bm25"], 1, documents=spark.createDataFrame([("d",)], "doc_id string"))


def test_evaluate_fills_places_with_chunks_that_share_no_term(spark, tmp_path):
    rows = [("AA", "c1", "10-K", "2025-01-01", "h", "cash rises"), ("AA", "c2", "8-K", "2025-02-01", "h", "board met"), ("AA", "c3", "8-K", "2025-02-01", "h", "vote held"), ("AA", "c4", "10-Q", "2025-03-01", "h", "cash")]
    chunks = spark.createDataFrame(rows, "ticker string, chunk_id string, filing_type string, filing_date string, section_heading string, text string")
    questions = spark.createDataFrame([("q1", 1, "What of cash stands in an 8-K?", "it met", "AA", 1, "true", "AA_8-K_2025-02-01", None), ("q2", 2, "Compare cash of 10-K with 8-K", "x", "AA", 2, "yes", "AA_MULTI", None)], tables.QUESTION)
    got = {r.qa_id: r for r in pipeline.evaluate(spark, questions, chunks, str(tmp_path / "run"), ["bm25"], 2).collect()}
    assert got["q1"].retrieved_chunk_ids == "c2|c3" and got["q1"].retrieval_scores == "0.000000|0.000000"
    assert set(got["q2"].retrieved_chunk_ids.split("|")) == {"c1", "c2"}


def test_describe_keeps_every_row_of_a_long_table(spark, tmp_path):
    d = str(tmp_path / "data")
    chunks = spark.range(1203).select(F.format_string("T%04d", "id").alias("ticker"), F.lit("10-K").alias("filing_type"), F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("x").alias("company"), F.lit("1").alias("cik"), F.lit("h").alias("section_heading"), F.lit("some text").alias("text"), F.lit(2).alias("word_count"), F.lit("2025-01-01").alias("filing_date"), F.col("id").cast("string").alias("accession_number"), F.col("id").cast("int").alias("chunk_index"))
    chunks.write.parquet(f"{d}/chunks.parquet")
    spark.createDataFrame([("u", ["w"], 10, 5, "AA", "10-K", "2025-01-01", "1", "text", None)], "source_url string, warnings array<string>, raw_length long, cleaned_length long, ticker string, filing_type string, filing_date string, accession_number string, human_readable_format string, local_markdown_path string").write.parquet(f"{d}/cleaning_manifest.parquet")
    text = pipeline.describe(spark, d, str(tmp_path / "report"))
    assert "| T0999 |" in text and "| T1000 |" not in text and "The first 1,000 of 1,203 rows; all are in `chunks_by_ticker_and_form.csv`." in text
    assert spark.read.option("header", True).csv(str(tmp_path / "report" / "chunks_by_ticker_and_form.csv")).select("ticker").distinct().count() == 1203
