"""Session settings and the shared places where intermediate tables are kept."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tablesmith") -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        # One machine only: driver and tasks share its folders.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tablesmith-"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the folder that the session was started with."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tablesmith/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Fix the rows of ``df`` in reliable storage so that re-runs see the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def settle(df: DataFrame, max_rows: int = 100_000) -> tuple[DataFrame, bool]:
    """Materialise a table that is usually tiny; says whether it is small enough to broadcast.

    Up to ``max_rows`` rows come back as a local relation (small = True). A larger table is
    checkpointed in the shared folder and must be joined with a shuffle (small = False).
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) <= max_rows:
        return df.sparkSession.createDataFrame(rows, df.schema), True
    return stable(df), False
