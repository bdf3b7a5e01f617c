"""Problem 6: lines that stand in record after record of one source, and their removal.

PrefixSpan over the sequence of line identifiers of each record, run as
DataFrame steps: the first step finds the frequent single lines of a source,
each further step extends every frequent sequence by the lines behind its
leftmost occurrence, which are all that a step hands on: the projection of the
one before. It ends when no sequence has support, the number of distinct records
of the source that hold it. What is deleted are the occurrences of the lines of
the mined sequences.

A line is identified by 128 bits of hash of its text without letter case and
with its spaces and tabs collapsed. The texts are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import record_key
from ledgerloom.operators.chunking import distinct_rows
from ledgerloom.session import cut_lineage


def same_line(line: Column) -> Column:
    """The form in which lines that differ only in letter case, spaces and tabs are equal."""
    return F.lower(F.trim(F.regexp_replace(line, "[ \t]+", " ")))


def company_of(df: DataFrame, cik_col: str, ticker_col: str) -> DataFrame:
    """``df`` with ``source``: the cik without leading zeros, else that of the same ticker, else the ticker; null where both are missing."""
    cik = F.nullif(F.regexp_replace(F.trim(F.col(cik_col).cast("string")), "^0+", ""), F.lit(""))
    ticker = F.nullif(F.upper(F.regexp_replace(F.col(ticker_col).cast("string"), r"(?U)^\s+|\s+$", "")), F.lit(""))
    keyed = df.withColumns({"__cik": cik, "__ticker": ticker})
    known = keyed.where("__cik IS NOT NULL AND __ticker IS NOT NULL").groupBy(F.col("__ticker").alias("__t")).agg(F.min("__cik").alias("__known"))
    # rows that have their cik, mostly all, don't meet the lookup; the others may share one ticker, which adaptive execution splits
    with_cik = keyed.where("__cik IS NOT NULL").withColumn("source", F.concat(F.lit("cik "), F.col("__cik")))
    without = keyed.where("__cik IS NULL").join(known, F.col("__ticker") == F.col("__t"), "left")
    without = without.withColumn("source", F.coalesce(F.concat(F.lit("cik "), F.col("__known")), F.concat(F.lit("ticker "), F.col("__ticker")))).drop("__t", "__known")
    return with_cik.unionByName(without).drop("__cik", "__ticker")


def _line_arrays(df: DataFrame, id_col: str, text_col: str, cik_col: str, ticker_col: str) -> DataFrame:
    """k, item, source and the non-blank lines (line_no, a, b) of each record, kept: what all steps read."""
    # each line is brought to its form once
    same = F.transform(F.split(F.col(text_col).cast("string"), "\n"), lambda line, i: F.struct(i.cast("long").alias("line_no"), same_line(line).alias("s")))
    lines = F.transform(F.filter(same, lambda x: x["s"].rlike(r"(?U)\S")), lambda x: F.struct(x["line_no"].alias("line_no"), F.xxhash64(F.lit(1), x["s"]).alias("a"), F.xxhash64(F.lit(2), x["s"]).alias("b")))
    read = df.where(F.col(text_col).isNotNull()).select(record_key(id_col, text_col).alias("k"), F.col(id_col).cast("string").alias("item"), F.hex(F.xxhash64(F.col(text_col).cast("string"))).alias("digest"), F.col(cik_col).alias("cik"), F.col(ticker_col).alias("ticker"), lines.alias("lines"))
    # repeated rows count once; two texts of one id are two records
    read = cut_lineage(read.where(F.size("lines") > 0))
    records = company_of(read.withColumn("k", F.concat_ws("\u0002", "k", "digest")), "cik", "ticker").where("source IS NOT NULL").select("k", "item", "source", "lines")
    return distinct_rows(records, "k")


def _single_lines(records: DataFrame, min_records: int) -> tuple[DataFrame, DataFrame]:
    """(records with their frequent lines in order, the frequent lines of each source with their support)."""
    line = ["source", "a", "b"]
    lines = records.select("k", "item", "source", F.inline("lines"))
    # a line's occurrences bound its records from above and combine before the shuffle, so one hot line moves little
    often = lines.groupBy(line).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_records).drop("n")
    some = cut_lineage(lines.join(often, line, "left_semi"))
    frequent = cut_lineage(some.groupBy(*line, "k").agg(F.count(F.lit(1))).groupBy(line).agg(F.count(F.lit(1)).alias("records")).where(F.col("records") >= min_records))
    kept = some.join(frequent.drop("records"), line, "left_semi")
    return kept, frequent


def _mined(kept: DataFrame, frequent: DataFrame, min_records: int, max_length: int | None) -> DataFrame:
    """source, seq array<struct<a, b>>, records of all frequent sequences, the single lines among them; of each level kept."""
    found = [frequent.select("source", F.array(F.struct("a", "b")).alias("seq"), "records")]
    ordered = kept.groupBy("k", "source").agg(F.array_sort(F.collect_list(F.struct("line_no", "a", "b"))).alias("x")).where(F.size("x") > 1)
    tails = ordered.select("k", "source", F.transform("x", lambda v: F.struct(v["a"].alias("a"), v["b"].alias("b"))).alias("tail"), F.array().cast("array<struct<a:bigint,b:bigint>>").alias("seq"))
    length = 1
    while length != max_length:
        # the lines behind the leftmost occurrence of a sequence, each at its first place there
        nexts = tails.select("k", "source", "seq", "tail", F.explode(F.array_distinct("tail")).alias("n"))
        grown = nexts.select("k", "source", F.concat("seq", F.array("n")).alias("seq"), F.slice("tail", F.array_position("tail", F.col("n")).cast("int") + 1, F.greatest(F.size("tail"), F.lit(1))).alias("tail"))
        if length == 1:
            # single lines are known to be frequent
            tails, length = cut_lineage(grown.where(F.size("tail") > 0)), 2
            continue
        grown = cut_lineage(grown)
        support = cut_lineage(grown.groupBy("source", "seq").agg(F.count(F.lit(1)).alias("records")).where(F.col("records") >= min_records))
        if support.isEmpty():
            break
        found.append(support)
        tails = cut_lineage(grown.where(F.size("tail") > 0).join(support.select("source", "seq"), ["source", "seq"], "left_semi"))
        length += 1
    return reduce(DataFrame.unionByName, found)


def _occurrences(records: DataFrame, min_records: int, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(occurrences of the lines of mined sequences: k, item, source, line_no; the sequences)."""
    kept, frequent = _single_lines(records, min_records)
    mined = _mined(kept, frequent, min_records, max_length)
    lines = mined.select("source", F.explode("seq").alias("l")).select("source", "l.a", "l.b").distinct()
    return kept.join(lines, ["source", "a", "b"], "left_semi").select("k", "item", "source", "line_no"), mined


def frequent_lines(df: DataFrame, id_col: str, text_col: str, cik_col: str, ticker_col: str, min_records: int = 10) -> DataFrame:
    """Every occurrence of a line of a frequent sequence of its source.

    Lines are counted from 0 in the text split at line feeds; blank ones are
    none. A line counts once in a record however often it stands there. Repeated
    rows of an id with one text count once; two texts of one id, and rows without
    an id, are told apart by their text; rows with neither cik nor ticker, null
    and empty texts have no lines. Other columns are ignored.

    Returns item_id, source, line_no bigint.
    """
    found, _ = _occurrences(_line_arrays(df, id_col, text_col, cik_col, ticker_col), min_records)
    return found.select(F.col("item").alias("item_id"), "source", "line_no").distinct()


def frequent_sequences(df: DataFrame, id_col: str, text_col: str, cik_col: str, ticker_col: str, min_records: int = 10, max_length: int | None = None) -> DataFrame:
    """The frequent sequences of lines of each source, with their support; of any length, or up to ``max_length`` lines.

    The lines of a sequence follow each other in a record, with others between
    them or not; a line may stand in it several times. Nulls and repeats as in
    ``frequent_lines``. The sequences of n lines that always stand together are
    2 ** n - 1, all of which are given.

    Returns source, length int, lines array<string> (as in ``same_line``), records bigint.
    """
    kept, frequent = _single_lines(_line_arrays(df, id_col, text_col, cik_col, ticker_col), min_records)
    sequences = _mined(kept, frequent, min_records, max_length).withColumn("length", F.size("seq"))
    # the wording of the frequent lines, from one pass over the texts
    wording = df.where(F.col(text_col).isNotNull()).select(F.explode(F.split(F.col(text_col).cast("string"), "\n")).alias("l")).select(same_line(F.col("l")).alias("l"))
    named = wording.select(F.xxhash64(F.lit(1), "l").alias("a"), F.xxhash64(F.lit(2), "l").alias("b"), "l").join(frequent.select("a", "b").distinct(), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.min("l").alias("l"))
    spelled = sequences.select("source", "length", "records", "seq", F.posexplode("seq").alias("i", "line")).select("*", "line.a", "line.b").join(named, ["a", "b"])
    return spelled.groupBy("source", "length", "records", "seq").agg(F.array_sort(F.collect_list(F.struct("i", "l"))).alias("x")).select("source", "length", F.transform("x", lambda v: v["l"]).alias("lines"), "records")


def remove_repeated_lines(df: DataFrame, id_col: str, text_col: str, cik_col: str, ticker_col: str, min_records: int = 10) -> DataFrame:
    """Each record's text without the lines of frequent sequences.

    Records without a frequent line keep their text as it is; a record left
    without lines has an empty text, a null text stays null. Repeated rows of an
    id with one text give one row; records without an id, and two texts of one
    id, are each cut by their own lines. Returns item_id, removed_lines int, clean_text.
    """
    found, _ = _occurrences(_line_arrays(df, id_col, text_col, cik_col, ticker_col), min_records)
    drop = found.groupBy("k").agg(F.collect_set("line_no").alias("drop"))
    text = F.col(text_col).cast("string")
    texts = df.select(F.concat_ws("\u0002", record_key(id_col, text_col), F.hex(F.xxhash64(text))).alias("k"), F.col(id_col).cast("string").alias("item_id"), text.alias("t"))
    # only records with a line to delete meet the deletions
    hit = distinct_rows(texts.join(drop.select("k"), "k", "left_semi"), "k").join(drop, "k")
    kept = F.array_join(F.filter(F.split("t", "\n"), lambda _, i: ~F.array_contains("drop", i.cast("long"))), "\n")
    cut = hit.select("item_id", F.size("drop").alias("removed_lines"), kept.alias("clean_text"))
    same = distinct_rows(texts.join(drop.select("k"), "k", "left_anti"), "k").select("item_id", F.lit(0).alias("removed_lines"), F.col("t").alias("clean_text"))
    return cut.unionByName(same)
