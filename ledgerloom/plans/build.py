"""The build stage: filings and their contents to a published dataset of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, cleaning, profile, selection, validation
from ledgerloom.sources import publish, tables
from ledgerloom.sources.files import Files

VERSION, SIZE, OVERLAP = 2, 400, 75
CHUNK_COLUMNS = [f.split()[0] for f in tables.CHUNK.split(", ")]
FILING_COLUMNS = [f.split()[0] for f in tables.FILING.split(", ")]
CHUNK_ORDER = ["ticker", "accession_number", "chunk_index"]


def sequence_hash(chunks: DataFrame) -> str:
    """A hash of the ids of every filing in the order of their index; independent of the order of filings."""
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("chunk_index").cast("int"), "chunk_id"))), lambda s: s["chunk_id"]), "|")
    per = chunks.groupBy("accession_number").agg(F.xxhash64("accession_number", ordered).alias("h"))
    return str(per.agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("h")).first().h)


def build_dataset(spark: SparkSession, filings: DataFrame, raw: DataFrame, out: str, cutoff: str, counts: dict[str, int], size: int = SIZE, overlap: int = OVERLAP, tickers: list[str] | None = None, complete: bool = False) -> dict:
    """Selects the latest filings of ``tickers``, or all, cleans and cuts their contents (``raw``: local_raw_path, content), validates and publishes ``out``.

    ``out`` holds chunks.parquet by ticker; the chunks in order as chunks.csv and
    chunks.jsonl; cleaning_manifest.parquet, filing_inventory.csv; summary.json
    and manifest.json. It is replaced as a whole, or not at all if a step fails.
    With ``complete``, every ticker must have exactly ``counts`` filings of each form.
    """
    chunking.check_window(size, overlap)
    validation.require_columns(filings, set(FILING_COLUMNS))
    dated = filings.withColumns({"ticker": T.norm_ticker(F.col("ticker")), "filed": T.parse_date(F.col("filing_date"))})
    tickers = sorted(validation.normalize_tickers(tickers)) if tickers else []
    if tickers:
        dated = dated.where(F.col("ticker").isin(tickers))
    latest = selection.latest_filings(dated, cutoff, counts).drop("rank")
    if complete:
        missed = validation.filing_policy(latest, ["ticker"], counts, cutoff, F.col("filed")).where("NOT policy_met").orderBy("ticker").limit(50).collect()
        if missed:
            raise ValueError(f"filings do not meet {counts}: {', '.join(str(r.ticker) for r in missed)}")
    # a filing without contents is an error, not a filing less
    found = latest.drop("filed").join(raw.select("local_raw_path", "content"), "local_raw_path", "left")
    held = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no contents of filing "), F.coalesce("accession_number", F.lit("?"))))).otherwise(F.col("content"))
    cleaned = cleaning.clean_documents(found.withColumn("content", held), "content", "raw_format").drop("content")
    kept = cleaned.select("company", "ticker", "cik", "filing_type", "filing_date", "accession_number", "source_url", F.col("local_raw_path").alias("source_file"), "cleaned_text")
    chunks = chunking.chunk_texts(kept, "cleaned_text", size, overlap).withColumn("chunk_schema_version", F.lit(VERSION)).select(*CHUNK_COLUMNS)
    stage, files = f"{out.rstrip('/')}.staged", Files(spark)
    publish.refuse_existing(spark, stage)
    try:
        tables.write_partitioned(chunks, f"{stage}/chunks.parquet", "ticker")
        cleaned.drop("cleaned_text").write.parquet(f"{stage}/cleaning_manifest.parquet")
        written = spark.read.parquet(f"{stage}/chunks.parquet")
        tables.write_csv(written, f"{stage}/chunks.csv", CHUNK_COLUMNS, CHUNK_ORDER)
        tables.write_jsonl(written, f"{stage}/chunks.jsonl", CHUNK_COLUMNS, CHUNK_ORDER)
        cleaning_manifest = spark.read.parquet(f"{stage}/cleaning_manifest.parquet")
        tables.write_csv(cleaning_manifest, f"{stage}/filing_inventory.csv", FILING_COLUMNS, ["ticker", "filing_type", "accession_number"])
        summary = dataset_summary(written, cleaning_manifest)
        files.write(f"{stage}/summary.json", publish.canonical_json(summary))
        validate_staged(spark, stage, size, cutoff)
        settings = {"schema_version": VERSION, "size": size, "overlap": overlap, "cutoff": cutoff, "counts": counts, "tickers": tickers, "chunks": summary["total_chunks"], "sequence": sequence_hash(written)}
        manifest = publish.write_manifest(spark, f"{stage}/manifest.json", settings)
        publish.publish(spark, {stage: out})
    except BaseException:
        files.delete(stage)
        raise
    return manifest


def dataset_summary(chunks: DataFrame, cleaned: DataFrame) -> dict:
    """Counts and word statistics of a dataset; a bounded record."""
    known = F.count_if(~T.is_missing(F.col("section_heading")) & (F.lower(T.strip(F.col("section_heading"))) != "unknown"))
    words = profile.describe(chunks, F.col("word_count")).first().asDict()
    total = chunks.agg(F.count(F.lit(1)).alias("n"), T.share(known, F.count(F.lit(1))).alias("known")).first()
    forms = {str(r.filing_type): r.n for r in cleaned.groupBy("filing_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "filing_type").limit(100).collect()}
    readable = cleaned.where(~T.is_missing(F.col("local_markdown_path"))).count()
    return {"filings": cleaned.count(), "filing_type_counts": forms, "human_readable_files": readable, "total_chunks": total.n, "average_words_per_chunk": words["mean"], "word_count_stats": words, "section_heading_coverage_pct": total.known}


def validate_staged(spark: SparkSession, stage: str, size: int, cutoff: str) -> None:
    """Raises an error unless the chunks keep the constraints, the CSV and JSON lines hold them in the same order, and the summary counts them."""
    import json

    chunks = spark.read.parquet(f"{stage}/chunks.parquet")
    validation.require_columns(chunks, set(CHUNK_COLUMNS))
    validation.assert_clean(validation.chunk_violations(chunks, size, cutoff, T.parse_date(F.col("filing_date"))))
    n, order = chunks.count(), sequence_hash(chunks)
    if not n:
        raise ValueError("no chunks")
    for name, copy in (("chunks.csv", tables.read_csv(spark, f"{stage}/chunks.csv", tables.CHUNK)), ("chunks.jsonl", tables.read_jsonl(spark, f"{stage}/chunks.jsonl", tables.CHUNK))):
        if copy.count() != n or sequence_hash(copy) != order:
            raise ValueError(f"{name} does not hold the chunks in order")
    if json.loads(Files(spark).read(f"{stage}/summary.json")).get("total_chunks") != n:
        raise ValueError("the summary does not count the chunks")


def is_current(spark: SparkSession, out: str, cutoff: str, counts: dict[str, int], size: int = SIZE, overlap: int = OVERLAP, tickers: list[str] | None = None) -> bool:
    """Whether a dataset there can be used as it is: its manifest is whole and of these settings and tickers, its chunks are those it was written with, of one schema version, and filings keep the counts and the cutoff. False if anything can't be read."""
    try:
        said = publish.check_manifest(spark, f"{out}/manifest.json", {"schema_version": VERSION, "size": size, "overlap": overlap, "cutoff": cutoff, "counts": counts, "tickers": sorted(validation.normalize_tickers(tickers)) if tickers else []})
        chunks = spark.read.parquet(f"{out}/chunks.parquet")
        if chunks.count() != said["chunks"] or sequence_hash(chunks) != said["sequence"]:
            return False
        if chunks.where(~F.col("chunk_schema_version").eqNullSafe(F.lit(VERSION))).limit(1).count():
            return False
        filed = chunks.withColumn("filed", T.parse_date(F.col("filing_date")))
        return not validation.filing_policy(filed, ["ticker"], counts, cutoff, F.col("filed")).where("NOT policy_met").limit(1).count()
    except Exception:  # noqa: BLE001 whatever makes it unreadable makes it unusable
        return False


def prune_dataset(spark: SparkSession, out: str) -> list[str]:
    """Deletes what a dataset's folder holds beside its own files; returns it."""
    return publish.prune(spark, out, ["chunks.parquet", "chunks.csv", "chunks.jsonl", "cleaning_manifest.parquet", "filing_inventory.csv", "summary.json", "manifest.json", "indexes"])
