"""Constraints as counts of the rows that break them, in one pass, and checks of settings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_missing, parse_boolean
from ledgerloom.operators.profile import counters
from ledgerloom.operators.scoring import gold_documents, overall_status


def require_columns(df: DataFrame, columns: set[str]) -> None:
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def violations(df: DataFrame, rules: dict[str, Column], unique: list[str] | None = None, unique_name: str = "duplicate_key") -> DataFrame:
    """metric, count of the rows that break each rule; and of rows beyond the first of each key."""
    out = counters(df, {k: F.coalesce(c, F.lit(False)) for k, c in rules.items()})
    if unique:
        extra = df.groupBy(*unique).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit(unique_name).alias("metric"), "count")
        out = out.unionByName(extra)
    return out


def assert_clean(report: DataFrame) -> None:
    broken = report.where("count > 0").orderBy("metric").limit(50).collect()
    if broken:
        raise ValueError("; ".join(f"{r.metric}: {r['count']}" for r in broken))


def chunk_violations(chunks: DataFrame, size: int, cutoff: str, filed: Column) -> DataFrame:
    w = F.col("word_count")
    rules = {
        "chunk_id_missing": is_missing(F.col("chunk_id")), "text_blank": is_missing(F.col("text")), "ticker_missing": is_missing(F.col("ticker")),
        "word_count_out_of_range": w.isNull() | (w < 1) | (w > size), "filed_after_cutoff": filed > F.lit(cutoff).cast("date"), "date_unreadable": filed.isNull(),
    }
    return violations(chunks, rules, ["chunk_id"], "duplicate_chunk_id")


def eval_violations(questions: DataFrame) -> DataFrame:
    rules = {
        "qa_id_missing": is_missing(F.col("qa_id")), "question_missing": is_missing(F.col("question")), "source_doc_id_missing": is_missing(F.col("source_doc_id")), "ticker_missing": is_missing(F.col("ticker")),
        "category_out_of_range": F.col("category").isNull() | ~F.col("category").between(1, 4), "answerable_unreadable": parse_boolean(F.col("answerable")).isNull(), "answer_missing": is_missing(F.col("answer")),
    }
    return violations(questions, rules, ["qa_id"], "duplicate_qa_id")


def result_violations(results: DataFrame, version: int, retrievers: list[str]) -> DataFrame:
    legal = overall_status(F.col("retrieval_status"), F.col("generation_status"))
    rules = {
        "schema_version_wrong": ~F.col("schema_version").eqNullSafe(F.lit(version)), "fingerprint_missing": is_missing(F.col("run_fingerprint")), "retriever_unknown": ~F.coalesce(F.col("retriever").isin(retrievers), F.lit(False)),
        "status_inconsistent": ~F.col("status").eqNullSafe(legal), "k_below_one": F.col("retrieval_k").isNull() | (F.col("retrieval_k") < 1), "category_out_of_range": F.col("category").isNull() | ~F.col("category").between(1, 4),
        "answerable_missing": F.col("answerable").isNull(),
    }
    return violations(results, rules, ["run_fingerprint", "qa_id", "retriever"], "duplicate_pair")


def missing_gold(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """qa_id, doc_id of the gold documents that aren't among ``documents`` (doc_id); markers without a list name none."""
    named = questions.select("qa_id", F.explode(gold_documents(F.col("source_doc_ids"), F.col("source_doc_id"))).alias("doc_id")).distinct()
    return named.join(documents.select("doc_id").distinct(), "doc_id", "left_anti").select("qa_id", "doc_id")


def filing_policy(filings: DataFrame, keys: list[str], counts: dict[str, int], cutoff: str, filed: Column) -> DataFrame:
    """Per key whether it has exactly ``counts`` distinct filings of each form, none after the cutoff or of another form."""
    number = lambda f: F.countDistinct(F.when(F.col("filing_type") == f, F.col("accession_number")))
    after = F.count_if(filed.isNull() | (filed > F.lit(cutoff).cast("date")))
    grouped = filings.groupBy(*keys).agg(*[number(f).alias(f"n_{i}") for i, f in enumerate(counts)], F.countDistinct("accession_number").alias("filings"), after.alias("late"))
    met = F.lit(True)
    for i, n in enumerate(counts.values()):
        met = met & (F.col(f"n_{i}") == n)
    return grouped.select(*keys, "filings", "late", (met & (F.col("filings") == sum(counts.values())) & (F.col("late") == 0)).alias("policy_met"))


def normalize_tickers(tickers: list[str]) -> list[str]:
    """Trimmed, upper case; raises on an empty list, bad characters and repeats (named in the order they appear)."""
    found = [t.strip().upper() for t in tickers]
    if not found:
        raise ValueError("no tickers")
    bad = [t for t in found if not re.fullmatch(r"[A-Z0-9.-]+", t)]
    if bad:
        raise ValueError(f"not tickers: {', '.join(bad)}")
    twice = list(dict.fromkeys(t for i, t in enumerate(found) if t in found[:i]))
    if twice:
        raise ValueError(f"repeated tickers: {', '.join(twice)}")
    return found


def dataset_name(tickers: list[str]) -> str:
    """The name of a dataset of these tickers: lower case, in their order, joined by underscores."""
    return "_".join(t.lower() for t in normalize_tickers(tickers))


def top_k_setting(argument: int | str | None, environment: str | None, default: int = 5) -> int:
    """The argument, else the environment, else the default; an integer of at least 1."""
    value = argument if argument is not None else environment if environment not in (None, "") else default
    try:
        k = int(str(value))
    except ValueError:
        raise ValueError(f"k must be an integer, not {value!r}") from None
    if k < 1:
        raise ValueError("k must be at least 1")
    return k


def run_name(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name):
        raise ValueError(f"not a run name: {name!r}")
    return name
