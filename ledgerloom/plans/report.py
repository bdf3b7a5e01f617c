"""The describe stage: tables and a report on a dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import profile
from ledgerloom.plans.build import SIZE, dataset_summary
from ledgerloom.sources import publish
from ledgerloom.sources.files import Files

#: Rows of a table that a report shows.
SHOWN = 1000
FIELDS = {
    "chunks": ["chunk_schema_version", "company", "ticker", "cik", "filing_type", "filing_date", "accession_number", "source_url", "source_file", "chunk_id", "chunk_index", "section_heading", "text", "word_count"],
    "cleaning_manifest": ["company", "ticker", "cik", "filing_type", "filing_date", "accession_number", "source_url", "local_raw_path", "raw_format", "local_markdown_path", "human_readable_format", "human_readable_warning", "raw_length", "cleaned_length", "warnings"],
}
HANDLING = {
    "duplicate_chunk_ids": "error", "empty_chunk_text_rows": "error", "oversized_chunks": "error", "short_chunks_under_100_words": "counted, kept", "low_retention_filings_under_15_pct": "counted, kept", "human_readable_text_fallbacks": "counted, kept",
}


def outlier_counts(chunks: DataFrame, cleaned: DataFrame, size: int = SIZE) -> DataFrame:
    """metric, count, handling of what is out of the ordinary; nothing is left out for it."""
    w = F.col("word_count")
    found = profile.counters(chunks, {"empty_chunk_text_rows": T.is_missing(F.col("text")), "oversized_chunks": F.coalesce(w > size, F.lit(False)), "short_chunks_under_100_words": F.coalesce(w < 100, F.lit(False))})
    twice = chunks.groupBy("chunk_id").agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count")).select(F.lit("duplicate_chunk_ids").alias("metric"), "count")
    kept = F.coalesce(F.col("cleaned_length") / F.nullif("raw_length", F.lit(0)) < 0.15, F.lit(False))
    low = profile.counters(cleaned, {"low_retention_filings_under_15_pct": kept, "human_readable_text_fallbacks": F.coalesce(F.col("human_readable_format") == "text", F.lit(False))})
    handling = F.element_at(F.create_map(*[F.lit(x) for kv in HANDLING.items() for x in kv]), F.col("metric"))
    return found.unionByName(twice).unionByName(low).withColumn("handling", handling)


def report_tables(chunks: DataFrame, cleaned: DataFrame) -> dict[str, DataFrame]:
    """The tables of a report by title, each in its order."""
    retained = F.round(100 * F.col("cleaned_length") / F.nullif("raw_length", F.lit(0)), 2)
    lengths = [profile.describe(cleaned, F.col(c)).select(F.lit(name).alias("text_version"), "*") for name, c in (("raw", "raw_length"), ("cleaned", "cleaned_length"))]
    missing = [profile.missingness(df, name, [f for f in FIELDS[name] if f in df.columns]) for name, df in (("chunks", chunks), ("cleaning_manifest", cleaned))]
    filed = T.parse_date(F.col("filing_date")).cast("string")
    return {
        "Filings by ticker and form": cleaned.groupBy("ticker", "filing_type").agg(F.count(F.lit(1)).alias("filings")).orderBy("ticker", "filing_type"),
        "Filing dates and accession numbers": cleaned.select("ticker", "filing_type", "filing_date", "accession_number").orderBy("ticker", "filing_type", "filing_date", "accession_number"),
        "Timeline": cleaned.groupBy("ticker").agg(F.min(filed).alias("first_filed"), F.max(filed).alias("last_filed"), F.count(F.lit(1)).alias("filings")).orderBy("ticker"),
        "Readable formats": cleaned.groupBy("human_readable_format").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "human_readable_format"),
        "Lengths in characters": lengths[0].unionByName(lengths[1]),
        "Lengths kept": profile.describe(cleaned, retained),
        "Lengths kept by ticker": profile.describe(cleaned, retained, ["ticker"]).orderBy("ticker"),
        "Chunks by ticker and form": profile.chunk_profile(chunks, ["ticker", "filing_type"]).orderBy("ticker", "filing_type"),
        "Words of a chunk": profile.describe(chunks, F.col("word_count")),
        "Most frequent sections": profile.section_profile(chunks).orderBy(F.desc("chunks"), "section_heading").limit(10),
        "Warnings": cleaned.select(F.explode("warnings").alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("filings")).orderBy(F.desc("filings"), "warning"),
        "Missing values": missing[0].unionByName(missing[1]).where("missing > 0"),
        "Outliers": outlier_counts(chunks, cleaned).orderBy("metric"),
    }


def describe(spark: SparkSession, folder: str, out: str) -> str:
    """Writes report.md, summary.json and every table of a dataset's report as CSV; a table of more than 1,000 rows is shown in part, and the report names its file."""
    chunks, cleaned = spark.read.parquet(f"{folder}/chunks.parquet"), spark.read.parquet(f"{folder}/cleaning_manifest.parquet")
    files, shown = Files(spark), []
    for title, df in report_tables(chunks, cleaned).items():
        # each table is an aggregate; the report shows its first 1,000 rows
        name = title.lower().replace(" ", "_") + ".csv"
        df.write.mode("overwrite").option("header", True).csv(f"{out}/{name}")
        rows = [tuple(r) for r in df.limit(SHOWN + 1).collect()]
        body = publish.markdown_table(df.columns, rows[:SHOWN])
        if len(rows) > SHOWN:
            body += f"\n\nThe first {SHOWN:,} of {df.count():,} rows; all are in `{name}`."
        shown.append(f"## {title}\n\n{body}")
    summary = dataset_summary(chunks, cleaned)
    head = f"{summary['filings']:,} filings, {summary['total_chunks']:,} chunks; {summary['section_heading_coverage_pct']} % of the chunks have a known heading. Missing values are counted, never filled in; no chunk is left out for being short, and one above the limit is an error."
    text = "# Dataset report\n\n" + head + "\n\n" + "\n\n".join(shown) + "\n"
    files.write(f"{out}/summary.json", publish.canonical_json(summary))
    files.write(f"{out}/report.md", text)
    return text


def is_fresh(spark: SparkSession, folder: str, out: str) -> bool:
    """Whether the summary in ``out`` is that of the dataset as it is."""
    import json

    try:
        said = json.loads(Files(spark).read(f"{out}/summary.json"))
    except (FileNotFoundError, ValueError):
        return False
    now = dataset_summary(spark.read.parquet(f"{folder}/chunks.parquet"), spark.read.parquet(f"{folder}/cleaning_manifest.parquet"))
    return said == json.loads(publish.canonical_json(now))
