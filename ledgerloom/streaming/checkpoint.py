"""The result log as a stream: each batch is merged into a table of last written rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.selection import last_written
from ledgerloom.session import cut_lineage
from ledgerloom.sources.files import Files


class LastWritten:
    """A parquet table in buckets of its keys. A batch writes anew only the buckets it touches; the list of current bucket folders is replaced last and as a whole, so readers never see a half-written state, and a batch that is run again changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.folder, self.keys, self.order, self.buckets = spark, folder.rstrip("/"), keys, order, buckets
        self.files = Files(spark)

    def _current(self) -> dict:
        path = f"{self.folder}/current.json"
        return json.loads(self.files.read(path)) if self.files.exists(path) else {"batch": -1, "buckets": self.buckets, "folders": {}}

    def _table(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*(f"{self.folder}/{f}" for f in folders)) if folders else None

    def read(self) -> DataFrame | None:
        return self._table(list(self._current()["folders"].values()))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        now = self._current()
        if now["batch"] >= batch_id:
            return
        # the table keeps the number of buckets it began with
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(now["buckets"])).cast("int")
        rows = cut_lineage(batch.withColumn("__bucket", bucket))
        touched = sorted(r[0] for r in rows.select("__bucket").distinct().collect())
        version = f"v{batch_id:012d}"
        self.files.delete(f"{self.folder}/{version}")
        former = self._table([now["folders"][str(b)] for b in touched if str(b) in now["folders"]])
        every = rows if former is None else rows.unionByName(former.withColumn("__bucket", bucket))
        last_written(every, self.keys, self.order).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{version}")
        after = now["folders"] | {str(b): f"{version}/__bucket={b}" for b in touched}
        self.files.write(f"{self.folder}/current.json", json.dumps({"batch": batch_id, "buckets": now["buckets"], "folders": after}))
        # folders that neither this list nor the former one names
        kept = set(after.values()) | set(now["folders"].values())
        for name in self.files.names(self.folder):
            if name.startswith("v"):
                for part in self.files.names(f"{self.folder}/{name}"):
                    if part.startswith("__bucket=") and f"{name}/{part}" not in kept:
                        self.files.delete(f"{self.folder}/{name}/{part}")


def follow_log(spark: SparkSession, path: str, schema: str, target: LastWritten, state: str):
    """Merges new files of the log folder until none is left; returns the finished query."""
    stream = spark.readStream.schema(schema).json(path)
    return stream.writeStream.foreachBatch(lambda df, i: target.merge(df, i)).option("checkpointLocation", state).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, by: list[str], width: str, late: str) -> DataFrame:
    """Rows per window and key of a stream or table; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), *by, "n")
