"""The tables as the queries see them: repeated rows once, identifiers in one form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import norm_ticker, parse_date
from ledgerloom.operators.chunking import unique_rows
from ledgerloom.operators.scoring import score_results
from ledgerloom.operators.selection import first_of, last_written
from ledgerloom.sources.tables import read_parquet, spread

CUTOFF = "2026-07-14"


def chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per chunk with ``columns``, or all; tickers in upper case."""
    read = read_parquet(spark, d, "chunks")
    if not columns or "text" in columns:
        read = spread(read)
    some = unique_rows(read.select("chunk_id", *[c for c in columns if c != "chunk_id"]) if columns else read, "chunk_id")
    return some.withColumn("ticker", norm_ticker(F.col("ticker"))) if "ticker" in some.columns else some


def chunk_texts(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """chunk_id, ticker, text and ``columns`` of the chunks with a ticker and a text."""
    return chunks(spark, d, "ticker", "text", *columns).where("ticker IS NOT NULL AND text IS NOT NULL")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return unique_rows(read_parquet(spark, d, "eval_set"), "qa_id").withColumn("ticker", norm_ticker(F.col("ticker")))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """The first delivery of each filing, with ``filed``, its date."""
    first = first_of(read_parquet(spark, d, "filings"), ["accession_number"], ["ingested_at"])
    return first.withColumns({"ticker": norm_ticker(F.col("ticker")), "filed": parse_date(F.col("filing_date"))})


def results(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """The last result of each pair, with ``columns`` or all; rows of a pair written at one time are copies or decided by ``columns``."""
    keys, order = ["run_fingerprint", "qa_id", "retriever"], ["recorded_at"]
    read = read_parquet(spark, d, "eval_results")
    return last_written(read.select(*keys, *order, *[c for c in columns if c not in (*keys, *order)]) if columns else read, keys, order)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return score_results(results(spark, d)).withColumn("ticker", norm_ticker(F.col("ticker")))
