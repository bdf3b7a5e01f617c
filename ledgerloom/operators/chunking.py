"""Sections of cleaned text and overlapping windows of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import chunk_id, squeeze, strip, words
from ledgerloom.session import cut_lineage


def check_window(size: int, overlap: int) -> None:
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be at least 1 and 0 <= overlap < size")


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """array<struct<start, n, text>> of the windows that start every ``size - overlap`` words, until one reaches the end."""
    n = F.size(tokens)
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1, F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(F.lit(size), n - s).alias("n"), F.array_join(F.slice(tokens, s + 1, size), " ").alias("text")))


def sections(text: Column) -> Column:
    """array<struct<heading, body>> of a cleaned text.

    Lines that begin with ``## `` open a section; the text before the first, and
    sections without a heading, are ``unknown``. Lines of a body are joined by a
    blank line; bodies without two letters in a row are left out.
    """
    # a heading that the split takes away is put back as the first line of its part
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n(?=## )")

    def section(part):
        lines = F.filter(F.transform(F.split(part, "\n"), strip), lambda x: x != "")
        headed = F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).rlike(r"^##(\s|$)")
        heading = F.when(headed, F.coalesce(F.nullif(squeeze(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^##\s*", "")), F.lit("")), F.lit("unknown"))).otherwise("unknown")
        body = F.when(headed, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
        return F.struct(heading.alias("heading"), F.array_join(body, "\n\n").alias("body"))

    with_try = F.transform(parts, section)
    return F.filter(with_try, lambda s: s["body"].rlike("[A-Za-z]{2,}"))


def chunk_texts(df: DataFrame, text_col: str, size: int = 400, overlap: int = 75) -> DataFrame:
    """Windows of the sections of each row's text, numbered within the row; windows never cross sections.

    Adds section_heading, chunk_index, text, word_count, chunk_id (from ticker
    and accession_number where the rows have them). Null and empty texts give no
    rows. Rows must be told apart by (ticker, accession_number).
    """
    check_window(size, overlap)
    cut = df.withColumn("__s", sections(F.col(text_col))).drop(text_col)
    cut = cut.withColumn("__w", F.flatten(F.transform("__s", lambda s: F.transform(windows(words(s["body"]), size, overlap), lambda w: F.struct(s["heading"].alias("h"), w["n"].alias("n"), w["text"].alias("t"))))))
    out = cut.select(*[c for c in df.columns if c != text_col], F.posexplode("__w").alias("chunk_index", "__c"))
    out = out.select("*", F.col("__c.h").alias("section_heading"), F.col("__c.t").alias("text"), F.col("__c.n").alias("word_count")).drop("__c")
    if {"ticker", "accession_number"} <= set(df.columns):
        out = out.withColumn("chunk_id", chunk_id(F.col("ticker"), F.col("accession_number"), F.col("chunk_index")))
    return out


#: Hashes of repeated keys that may be broadcast (8 bytes each).
BROADCAST_KEYS = 2_000_000


def unique_rows(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the least of its rows, and a null key once. Select the columns that are needed first: others are neither read nor compared then.

    Only rows whose key stands several times need to meet, so that long values of the others aren't moved.
    """
    rest = [c for c in df.columns if c != key]
    again = df.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__key")
    same = F.col(key).eqNullSafe(F.col("__key"))
    several = df.join(again, same, "left_semi")
    least = several.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[F.asc_nulls_last(c) for c in rest]))).where("__n = 1").drop("__n")
    return df.join(again, same, "left_anti").unionByName(least)


def distinct_rows(df: DataFrame, key: str) -> DataFrame:
    """The distinct rows, of which equal ones share ``key``.

    As in ``unique_rows``, only rows of repeated keys meet; their keys are found
    first, as hashes, and broadcast if they are no more than ``BROADCAST_KEYS``.
    """
    hashed = F.xxhash64(key)
    again = cut_lineage(df.groupBy(hashed.alias("__h")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__h"))
    side = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    # keys of one hash that differ go the longer way as well
    return df.join(side, hashed == F.col("__h"), "left_anti").unionByName(df.join(side, hashed == F.col("__h"), "left_semi").distinct())
