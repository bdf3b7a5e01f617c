"""The data behind each figure on questions, filings and scores, written as a set."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import profile
from ledgerloom.operators.scoring import METRICS
from ledgerloom.sources.files import Files


def coverage(questions: DataFrame) -> DataFrame:
    """Of each ticker and question 2: several documents asked for, 1: answered, 0: open; the greatest counts."""
    state = F.when(F.col("source_doc_id").endswith("_MULTI"), 2).when(~T.is_missing(F.col("answer")), 1).otherwise(0)
    return questions.groupBy("ticker", "question_id").agg(F.max(state).alias("state"))


def figures(questions: DataFrame, filings: DataFrame, scored: DataFrame, retrievers: tuple[str, str] = ("faiss", "bm25")) -> dict[str, Callable[[], DataFrame]]:
    """The figures' data by name, each made when it is called."""
    both, metrics = list(retrievers), [m for m in METRICS if m not in ("retrieval_success", "generation_success")]
    tickers = lambda: [r.ticker for r in scored.select("ticker").where("ticker IS NOT NULL").distinct().orderBy("ticker").limit(1000).collect()]  # noqa: E731 a figure shows no more
    deltas = lambda: profile.paired_deltas(scored, ["run_fingerprint", "qa_id", "category"], retrievers)
    return {
        "coverage": lambda: coverage(questions),
        "timeline": lambda: filings.select("ticker", "filing_type", T.parse_date(F.col("filing_date")).cast("string").alias("filed"), "accession_number").where("filed IS NOT NULL"),
        "metric_means": lambda: profile.means_over(scored, {"retriever": both}),
        "availability": lambda: profile.availability(scored, ["retriever"]),
        "outcomes": lambda: profile.outcomes(scored, ["retriever"]),
        "category_means": lambda: profile.means_over(scored, {"category": list(T.CATEGORY_LABELS), "retriever": both}),
        "ticker_means": lambda: profile.means_over(scored, {"ticker": tickers(), "retriever": both}),
        "answerable_means": lambda: profile.means_over(scored, {"answerable": [True, False], "retriever": both}),
        "category_deltas": lambda: profile.category_deltas(deltas(), "category"),
        "distributions": lambda: profile.box_stats(profile.long_metrics(scored, ["retriever"]), ["retriever", "metric"], "value"),
        "question_deltas": lambda: deltas().select("qa_id", "metric", "delta"),
        "delta_extremes": lambda: profile.delta_extremes(deltas().withColumn("question", F.col("qa_id")), "question"),
        "correlations": lambda: profile.correlations(scored, ["retriever"], metrics),
    }


def write_figures(spark: SparkSession, made: dict[str, Callable[[], DataFrame]], out: str) -> dict[str, str]:
    """Writes each figure's data as CSV below ``out`` and returns what became of each: ``written``, ``empty`` or its error. A figure that is empty or fails leaves no former data, and stops no other."""
    files, said = Files(spark), {}
    for name, make in made.items():
        path = f"{out}/{name}.csv"
        files.delete(path)
        try:
            df = make()
            if df.isEmpty():
                said[name] = "empty"
                continue
            df.orderBy(*df.columns).write.option("header", True).csv(path)
            said[name] = "written"
        except Exception as e:  # noqa: BLE001 whatever stops one figure is its own
            files.delete(path)
            said[name] = f"{type(e).__name__}: {e}"[:160]
    for name in files.names(out):
        if name.endswith(".csv") and name.removesuffix(".csv") not in made:
            files.delete(f"{out}/{name}")
    return said
