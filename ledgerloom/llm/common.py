"""What the corpus operators share: reading, keys and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.tables import read_parquet, spread

#: Rows in an Arrow batch of texts; keeps a batch of long texts small beside an executor's memory.
TEXT_BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(read_parquet(spark, sf_dir, name))


def record_key(id_col: str, *value_cols: str) -> Column:
    """The id of a record; rows without one are told apart by the md5 of their values."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001")) for c in value_cols]
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("\u0000"), F.md5(F.concat_ws("\u0002", *values))))


def batches_of(table_batch: pa.RecordBatch, rows: int = TEXT_BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    for at in range(0, table_batch.num_rows, rows):
        yield table_batch.slice(at, rows)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)
