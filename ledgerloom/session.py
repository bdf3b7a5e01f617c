"""Session settings and the few places that touch session state."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Get or create a session with the settings the operators expect.

    Adaptive execution, UTC and Arrow are on. Memory, executors and the shared
    checkpoint folder belong to the cluster and are left to its settings.
    """
    b = SparkSession.builder.appName("ledgerloom")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints are removed once nothing refers to them
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder checkpoints go to: the cluster's shared one, else a local one.

    ``spark.checkpoint.dir`` names the folder all executors share. Only where
    neither it nor a context checkpoint folder is set (tests, local mode) a
    folder of this process is used.
    """
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if now:
        return now
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="ledgerloom-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
