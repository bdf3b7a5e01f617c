"""Choosing rows: latest, first, last written, open work, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group; the filter on the rank lets tasks drop rows before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def latest_filings(filings: DataFrame, cutoff: str, counts: dict[str, int]) -> DataFrame:
    """Per ticker the latest filings of each form, as many as ``counts`` says, dated to ``cutoff`` inclusive; ties go to the greater accession number.

    Expects one row per accession number. Rows without a readable date drop out.
    """
    wanted = filings.where(F.col("filed") <= F.lit(cutoff).cast("date")).where(F.col("filing_type").isin(list(counts)))
    # few forms with few rows each: one rank with the largest count lets the limit work before the shuffle
    ranked = top_rows(wanted, ["ticker", "filing_type"], [F.desc("filed"), F.desc("accession_number")], max(counts.values()))
    n = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    r = F.row_number().over(Window.partitionBy("ticker", "filing_type").orderBy(F.desc("filed"), F.desc("accession_number")))
    return ranked.withColumn("rank", r).where(F.col("rank") <= F.element_at(n, F.col("filing_type")))


def last_written(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the order of the log, nulls first; ties are equal in ``order`` and decided by all other columns. Select the columns that are needed first: others are neither read nor moved then."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return top_rows(df, keys, [F.desc_nulls_last(c) for c in [*order, *rest]], 1)


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    return top_rows(df, keys, [F.asc_nulls_last(c) for c in [*order, *rest]], 1)


def open_work(questions: DataFrame, retrievers: list[str], results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each question with each retriever, but those whose latest result, by ``order``, is ok: an error behind an ok result opens the pair again."""
    work = questions.withColumn("retriever", F.explode(F.array(*[F.lit(r) for r in retrievers])))
    latest = last_written(results.select(*keys, "retriever", *order, "status"), [*keys, "retriever"], order)
    return work.join(latest.where("status = 'ok'").select(*keys, "retriever"), [*keys, "retriever"], "left_anti")


def reserved_top_k(ranked: DataFrame, query: str, form: str, rank: str, k: int, forms: str, reserve: str) -> DataFrame:
    """Of the rows of each query, by ``rank``, the best ``k`` whose form is among ``forms`` (all, where that is empty); forms of rows are compared without padding and letter case.

    Where ``reserve`` holds and at least two forms are named, the best row of
    each has a place, in the order of mention while places last; others fill
    the rest by rank. Rows come with ``place``, their order by rank.
    """
    plain = F.upper(F.trim(F.col(form).cast("string")))
    named = F.transform(forms, lambda f: F.upper(F.trim(f.cast("string"))))
    allowed = ranked.withColumn("__form", plain).where((F.size(forms) == 0) | F.coalesce(F.array_contains(named, F.col("__form")), F.lit(False)))
    best = F.row_number().over(Window.partitionBy(query, "__form").orderBy(rank))
    mention = F.array_position(named, F.col("__form"))
    first = F.col(reserve) & (F.size(forms) >= 2) & (F.col("__best") == 1)
    chosen = top_rows(allowed.withColumn("__best", best).withColumn("__class", F.when(first, mention).otherwise(10**6)), [query], [F.asc("__class"), F.asc(rank)], k)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(query).orderBy(rank))).drop("__best", "__class", "__form")
