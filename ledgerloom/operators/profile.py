"""Reports: counts, shares and statistics of tables and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.text import is_missing, share
from ledgerloom.operators.scoring import METRICS, RANGES, STATUSES


def chunk_profile(chunks: DataFrame, keys: list[str]) -> DataFrame:
    w = F.col("word_count")
    return chunks.groupBy(*keys).agg(
        F.count("chunk_id").alias("chunks"), F.countDistinct("accession_number").alias("filings"), F.sum(w).cast("long").alias("total_words"), F.round(F.avg(w) + 1e-9, 2).alias("mean_words"),
        F.round(F.median(w), 2).alias("median_words"), F.min(w).alias("min_words"), F.max(w).alias("max_words"), F.count_if(F.lower("section_heading") == "unknown").alias("unknown_sections"),
    )


def section_profile(chunks: DataFrame) -> DataFrame:
    """Chunks, tickers and forms of each heading, as written."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ", ")
    counted = chunks.groupBy("section_heading").agg(F.count("chunk_id").alias("chunks"), joined("ticker").alias("tickers"), joined("filing_type").alias("filing_types"))
    total = chunks.agg(F.count(F.lit(1)).alias("total"))
    # the total is one row
    return counted.join(F.broadcast(total)).select("*", share(F.col("chunks"), F.col("total")).alias("chunk_pct")).drop("total")


def missingness(df: DataFrame, dataset: str, fields: list[str]) -> DataFrame:
    """Missing values of each field, in one pass; of a field the table lacks, all."""
    def missing(f):
        if f not in df.columns:
            return F.count(F.lit(1))
        return F.count_if(F.col(f).isNull() if dict(df.dtypes)[f].startswith(("array", "map", "struct")) else is_missing(F.col(f)))

    one = df.agg(F.count(F.lit(1)).alias("__rows"), *[missing(f).alias(f) for f in fields])
    long = one.unpivot(["__rows"], fields, "field", "missing")
    return long.select(F.lit(dataset).alias("dataset"), "field", F.col("__rows").alias("rows"), "missing", share(F.col("missing"), F.col("__rows")).alias("missing_pct"))


def describe(df: DataFrame, value: Column, by: list[str] | None = None) -> DataFrame:
    """n, min, p25, median, mean, p75, max; quantiles interpolated, all 0 without values."""
    def zero(c):
        return F.coalesce(F.round(c, 2), F.lit(0.0))

    v = value.cast("double")
    q = lambda p: F.percentile(v, F.lit(p))
    made = [F.count(v).alias("n"), zero(F.min(v)).alias("min"), zero(q(0.25)).alias("p25"), zero(q(0.5)).alias("median"), zero(F.avg(v) + 1e-9).alias("mean"), zero(q(0.75)).alias("p75"), zero(F.max(v)).alias("max")]
    return df.groupBy(*by).agg(*made) if by else df.agg(*made)


def counters(df: DataFrame, named: dict[str, Column]) -> DataFrame:
    """metric, count: how many rows each condition holds for, in one pass."""
    return df.agg(*[F.count_if(c).alias(m) for m, c in named.items()]).unpivot([], list(named), "metric", "count")


def long_metrics(scored: DataFrame, keep: list[str]) -> DataFrame:
    return scored.unpivot(keep, [F.col(m) for m in METRICS], "metric", "value")


def metric_means(scored: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Means of the metrics over each set of dimensions, to four places with ties up, in one pass over the rows; ``grouping`` names the set, other dimensions are null."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    made = [F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m) + 1e-9, 4).alias(m) for m in METRICS]]
    grouped = scored.groupingSets([[F.col(d) for d in s] for s in sets], *[F.col(d) for d in dims]).agg(F.grouping_id().alias("__g"), *made)
    code = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s): "+".join(s) for s in sets}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in code.items() for x in kv]), F.col("__g").cast("int"))
    return grouped.select(name.alias("grouping"), *dims, "n", *METRICS)


def availability(scored: DataFrame, by: list[str]) -> DataFrame:
    return long_metrics(scored, by).groupBy(*by, "metric").agg(F.count("value").alias("eligible"), F.count(F.lit(1)).alias("rows"), F.round(F.count("value") / F.count(F.lit(1)), 4).alias("share"))


def outcomes(results: DataFrame, by: list[str]) -> DataFrame:
    return results.groupBy(*by).pivot("status", list(STATUSES)).agg(F.count(F.lit(1))).fillna(0, list(STATUSES))


def correlations(scored: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Pearson's correlation of each pair of metrics over the rows that have both; null without variance."""
    pairs = [(a, b) for i, a in enumerate(metrics) for b in metrics[i + 1 :]]

    def corr(a, b):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        # by the moments, as the built-in one divides by a variance of nought
        return F.when((F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0), F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))

    wide = scored.groupBy(*by).agg(*[F.round(corr(a, b), 5).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot(by, [f"`{a}|{b}`" for a, b in pairs], "pair", "r")
    return long.select(*by, F.split_part("pair", F.lit("|"), F.lit(1)).alias("metric_a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("metric_b"), "r")


def box_stats(long: DataFrame, by: list[str], value: str) -> DataFrame:
    """Quartiles, and whiskers at the last values within 1.5 interquartile ranges."""
    q = long.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    q = q.withColumn("lo", F.col("q")[0] - reach).withColumn("hi", F.col("q")[2] + reach)
    inside = long.where(F.col(value).isNotNull()).join(q, by).where(F.col(value).between(F.col("lo"), F.col("hi")))
    r = lambda c: F.round(c, 6)
    return inside.groupBy(*by, "n", "q").agg(r(F.min(value)).alias("whisker_low"), r(F.max(value)).alias("whisker_high")).select(*by, "n", r(F.col("q")[0]).alias("p25"), r(F.col("q")[1]).alias("median"), r(F.col("q")[2]).alias("p75"), "whisker_low", "whisker_high")


def metric_pivot(scored: DataFrame, keep: list[str], retrievers: tuple[str, str] = ("faiss", "bm25")) -> DataFrame:
    """Mean value of each question and metric, a column per retriever."""
    return long_metrics(scored, [*keep, "retriever"]).groupBy(*keep, "metric").pivot("retriever", list(retrievers)).agg(F.avg("value"))


def paired_deltas(scored: DataFrame, keep: list[str], retrievers: tuple[str, str] = ("faiss", "bm25")) -> DataFrame:
    """First minus second retriever for each question and metric that has both."""
    a, b = retrievers
    return metric_pivot(scored, keep, retrievers).where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keep, "metric", F.round(F.col(a) - F.col(b), 6).alias("delta"))


def delta_extremes(deltas: DataFrame, question: str, n: int = 2) -> DataFrame:
    """The ``n`` least and greatest deltas of each metric beside its median; ties by question."""
    up = Window.partitionBy("metric").orderBy("delta", question)
    down = Window.partitionBy("metric").orderBy(F.desc("delta"), F.desc(question))
    medians = deltas.groupBy("metric").agg(F.round(F.median("delta"), 6).alias("median_delta"))
    low = deltas.withColumn("r", F.row_number().over(up)).where(F.col("r") <= n).withColumn("side", F.lit("low"))
    high = deltas.withColumn("r", F.row_number().over(down)).where(F.col("r") <= n).withColumn("side", F.lit("high"))
    return low.unionByName(high).join(medians, "metric").select("metric", "side", "r", question, "delta", "median_delta")


def category_deltas(deltas: DataFrame, category: str) -> DataFrame:
    """Mean delta by category and metric, raw and over the metric's range."""
    span = F.element_at(F.create_map(*[F.lit(x) for m in METRICS for x in (m, RANGES[m][1] - RANGES[m][0])]), F.col("metric"))
    return deltas.groupBy(category, "metric").agg(F.avg("delta").alias("d"), F.count(F.lit(1)).alias("n")).select(category, "metric", "n", F.round("d", 6).alias("mean_delta"), F.round(F.col("d") / span, 6).alias("normalized_delta"))


def means_over(scored: DataFrame, dims: dict[str, list]) -> DataFrame:
    """Means of the metrics for every combination of the given values, also of those without a row, which count 0 and have null means."""
    spark, kinds = scored.sparkSession, dict(scored.dtypes)
    spine = None
    for d, values in dims.items():
        one = spark.createDataFrame([(v,) for v in values], f"{d} {kinds[d]}")
        spine = one if spine is None else spine.join(one, F.lit(True))  # a few given values
    counted = scored.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(m) + 1e-9, 4).alias(m) for m in METRICS])
    return spine.join(counted, list(dims), "left").select(*dims, F.coalesce("n", F.lit(0)).alias("n"), *METRICS)
