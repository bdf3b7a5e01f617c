"""Schemas, readers and writers of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_missing
from ledgerloom.sources.files import Files
from ledgerloom.sources.publish import publish

FILING = "company string, ticker string, cik string, filing_type string, filing_date string, accession_number string, source_url string, local_raw_path string, raw_format string, local_markdown_path string, human_readable_format string, human_readable_warning string"
CHUNK = "chunk_schema_version int, company string, ticker string, cik string, filing_type string, filing_date string, accession_number string, source_url string, source_file string, chunk_id string, chunk_index int, section_heading string, text string, word_count int"
QUESTION = "qa_id string, question_id int, question string, answer string, ticker string, category int, answerable string, source_doc_id string, source_doc_ids string"
RESULT = (
    "schema_version int, run_fingerprint string, qa_id string, ticker string, question_id int, category int, answerable boolean, question string, ground_truth string, source_doc_id string, source_doc_ids string, source_chunk_ids string,"
    " llm_answer string, retrieved_chunk_ids string, retrieved_doc_ids string, retrieval_scores string, retrieved_sections string, retrieved_filing_dates string, retrieval_k int, retriever string, llm_model string,"
    " retrieval_status string, retrieval_error string, generation_status string, generation_error string, status string"
)


def read_parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Partitions of a table that may be spread: with files of usual size, up to about a gigabyte.
FEW_PARTITIONS = 8


def spread(df: DataFrame) -> DataFrame:
    """A table as read, over all cores where its files make few partitions and fewer than half as many: a file of one row group is read by one task, which would do all work on its texts alone."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(cores) if parts <= min(FEW_PARTITIONS, cores // 2) else df


def read_csv(spark: SparkSession, path: str, schema: str, encoding: str = "utf-8") -> DataFrame:
    """A CSV with a header; values may hold line breaks and doubled quotes, types come from the schema alone."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', quote='"', encoding=encoding, enforceSchema=False)


def csv_encoding(spark: SparkSession, path: str) -> str:
    """utf-8 if all lines of the file or folder are, else latin-1."""
    lines = spark.read.text(path)
    return "utf-8" if lines.where(~F.is_valid_utf8("value")).isEmpty() else "latin-1"


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array or object over several lines; a missing file names the stage that makes it."""
    _must_exist(spark, path)
    return spark.read.json(path, schema=schema, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line; blank lines are none, malformed ones raise an error."""
    _must_exist(spark, path)
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_records(spark: SparkSession, path: str, schema: str, required: list[str], defaults: dict[str, object] | None = None) -> DataFrame:
    """JSON lines or an array (by a name that ends in ``.json``) with defaults for missing values; a record without a required one raises an error that names it."""
    rows = read_json(spark, path, schema) if path.endswith(".json") else read_jsonl(spark, path, schema)
    for c, v in (defaults or {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    lacking = F.concat_ws(", ", *[F.when(is_missing(F.col(c)), F.lit(c)) for c in required])
    first = required[0]
    return rows.withColumn(first, F.when(lacking != "", F.raise_error(F.concat(F.lit("a record lacks "), lacking))).otherwise(F.col(first)))


def _must_exist(spark: SparkSession, path: str) -> None:
    if not Files(spark).exists(path):
        raise FileNotFoundError(f"{path} is missing; run the preceding pipeline stage")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, content of whole files; bytes that aren't UTF-8 become replacement characters."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of an append-only log, a file or a folder of them, with ``log_file``, ``log_at`` and ``log_no``: where each stands in its file.

    A malformed last line of a file, the trace of an interrupted write, is left
    out; a malformed line elsewhere raises an error when it is read. Records of
    different files are ordered by what they hold.
    """
    _must_exist(spark, path)
    place = {"log_file": F.input_file_name(), "log_at": F.input_file_block_start(), "log_no": F.monotonically_increasing_id()}
    lines = spark.read.text(path).withColumns(place).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"}))
    good = parsed.where("r.__bad IS NULL").select("r.*", *place).drop("__bad")
    # malformed lines are few: they meet the last place of their file
    ends = lines.groupBy("log_file").agg(F.max(F.struct("log_at", "log_no")).alias("end"))
    bad = parsed.where("r.__bad IS NOT NULL").join(ends, "log_file").where(F.struct("log_at", "log_no") < F.col("end"))
    # one row: a malformed line, if there is any
    first = bad.agg(F.max(F.left("value", F.lit(80))).alias("__bad"))
    whole = F.when(F.col("__bad").isNotNull(), F.raise_error(F.concat(F.lit("malformed record: "), F.col("__bad"))).cast("boolean")).otherwise(True)
    return good.join(first, F.lit(True)).where(whole).drop("__bad")


def repair_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The whole records of a log, after its malformed last lines were taken off: the log is written anew beside and put in place, if there are any."""
    records = read_checkpoint(spark, path, schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    if lines.count() == records.count():
        return records
    whole = records.orderBy("log_file", "log_at", "log_no").drop("log_file", "log_at", "log_no")
    staged = f"{path.rstrip('/')}.repaired"
    whole.write.mode("overwrite").json(staged, ignoreNullFields=False)
    publish(spark, {staged: path})
    return read_checkpoint(spark, path, schema)


def newest_run(spark: SparkSession, folder: str, name: str = "results") -> str:
    """The latest written ``*/name`` of a folder."""
    found = sorted((t, p) for run in Files(spark).names(folder) if (t := Files(spark).modified(p := f"{folder}/{run}/{name}")) is not None)
    if not found:
        raise FileNotFoundError(f"no {name} below {folder}")
    return found[-1][1]


def write_csv(df: DataFrame, path: str, columns: list[str], order: list[str], mode: str = "errorifexists") -> None:
    """CSV with a header, columns and rows in the given order over all part files."""
    df.select(*columns).orderBy(*order).write.csv(path, mode=mode, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_jsonl(df: DataFrame, path: str, columns: list[str], order: list[str], mode: str = "errorifexists") -> None:
    df.select(*columns).orderBy(*order).write.json(path, mode=mode, ignoreNullFields=False)


def write_partitioned(df: DataFrame, path: str, key: str, mode: str = "errorifexists", files_per_key: int = 8) -> None:
    """Parquet by key; a hot key is spread over up to ``files_per_key`` files."""
    rest = [c for c in df.columns if c != key]
    df.repartition(F.col(key), F.pmod(F.xxhash64(*rest), F.lit(files_per_key))).write.partitionBy(key).parquet(path, mode=mode)


def append_checkpoint(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path, ignoreNullFields=False)
