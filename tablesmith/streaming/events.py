"""Streaming sources and the way results of a finite run are collected."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesmith.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", glob: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The table ``<folder>/<name>.parquet`` as a stream, be it a file or a folder of files."""
    # Braces make the path a pattern: Spark's streams take folders and patterns, a plain path to a file they refuse.
    return file_stream(spark, f"{folder}/{{{name}}}.parquet", schema)


def event_stream(spark: SparkSession, path: str, schema, ts: str = "ts", **kw) -> DataFrame:
    """Event files as a stream; the time column becomes a time stamp that watermarks accept."""
    return file_stream(spark, path, schema, **kw).withColumn(ts, F.col(ts).cast("timestamp"))


def with_lateness(sdf: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    return sdf.withWatermark(ts, delay)


def drain(sdf: DataFrame, mode: str = "append", checkpoint: str | None = None,
          each: Callable[[DataFrame, int], None] | None = None, out: str | None = None, progress: list[dict] | None = None) -> str:
    """Process what is available now, batch by batch, into ``<path>/batch=<id>`` Parquet folders.

    A batch that is repeated after a failure overwrites its own folder, so results appear once. The
    rows go from tasks to files; nothing passes through the driver. ``progress`` collects Spark's account of each batch.
    """
    spark = sdf.sparkSession
    out = out or scratch_path(spark, "stream")

    def write(batch: DataFrame, batch_id: int) -> None:
        if each is not None:
            each(batch, batch_id)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = (
        sdf.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or scratch_path(spark, "state"))
        .trigger(availableNow=True).start())
    query.awaitTermination()
    if progress is not None:
        progress.extend(json.loads(p.json) for p in query.recentProgress)
    return out


def time_slices(df: DataFrame, ts: str, n: int) -> list[DataFrame]:
    """``df`` cut into ``n`` equal spans of time, oldest first; rows without a time come first of all."""
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(t), F.max(t)).first()
    if low is None:
        return [df]
    step = (high - low) // n + 1
    at = F.coalesce(F.floor((t - low) / step), F.lit(0))
    return [df.where(at == i) for i in range(n)]


def arriving(slices: Iterable[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append", ts: str | None = None,
             keys: list[str] | None = None, each: Callable[[DataFrame, int], None] | None = None, progress: list[dict] | None = None) -> DataFrame | None:
    """Files that arrive slice by slice, each taken up by a fresh run of the same job.

    Every run starts from the checkpoint of the one before, so state and watermark outlive it. Returns what the runs
    wrote (see ``collected``), or nothing when ``each`` writes itself.
    """
    folder = state = out = schema = None
    for i, rows in enumerate(slices):
        spark = rows.sparkSession
        if folder is None:
            folder, state, out = (scratch_path(spark, x) for x in ("arriving", "state", "stream"))
        rows.write.parquet(f"{folder}/slice-{i}")
        source = file_stream(spark, f"{folder}/*", rows.schema)
        sdf = build(source.withColumn(ts, F.col(ts).cast("timestamp")) if ts else source)
        schema = sdf.schema
        drain(sdf, mode, state, each, out, progress)
    return None if each is not None or schema is None else collected(spark, out, schema, mode, keys)


def collected(spark: SparkSession, out: str, schema, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """The result table of finished runs.

    append: all rows. complete: the last batch. update: the last row of each key.
    """
    columns = list(schema.names)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if mode == "complete":
        last = rows.agg(F.max("batch")).scalar()
        rows = rows.where(F.col("batch") == last)
    elif mode == "update":
        newest = F.max_by(F.struct(*columns), "batch").alias("_r")
        rows = rows.groupBy(*keys).agg(newest).select("_r.*").withColumn("batch", F.lit(0))
    return rows.drop("batch")


def drained(sdf: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """The result table of one finite run, see ``collected``."""
    schema = sdf.schema
    return collected(sdf.sparkSession, drain(sdf, mode), schema, mode, keys)


def pane_windows(df: DataFrame, ts: str, counts: dict[str, Column], window: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums of ``counts`` per window (and ``by``); for batches and streams alike.

    Sliding windows are put together from panes of one slide: every row is counted once, in its pane, and only the panes'
    sums go to the windows that hold them.
    """
    by = by or []
    if slide is None:
        return df.groupBy(F.window(ts, window).alias("w"), *by).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    panes = df.groupBy(F.window(ts, slide).alias("pane"), *by).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    return panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), *by).agg(*[F.sum(n).alias(n) for n in counts])


def security_windows(df: DataFrame, window: str = "1 day", slide: str | None = None) -> DataFrame:
    """Totals, risky events, failures and denials per window; for batches and streams alike.

    On a stream with a watermark each window comes once, when it can no longer change, and then leaves the state.
    """
    one = lambda test: F.when(test, 1).otherwise(0).cast("long")
    return pane_windows(df, "ts", {
        "total_events": F.lit(1).cast("long"), "security_events": one(F.col("risk_level").isin("high", "critical")),
        "failed_logins": one(F.col("event_type") == "login_failed"), "access_denials": one(F.col("event_type") == "access_denied")}, window, slide)


def call_bursts(df: DataFrame, ts: str, user: str, limit: int, window: str, slide: str) -> DataFrame:
    """Calls of each user in each window, and whether they exceed ``limit``; for batches and streams alike."""
    calls = pane_windows(df.where(F.col(user).isNotNull()), ts, {"calls": F.lit(1).cast("long")}, window, slide, [user])
    return calls.withColumn("over_limit", F.col("calls") > limit)


def rollup_stream(sdf: DataFrame, ts: str, value: str, by: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Running figures per window, for update mode: a window leaves the state when it is older than the delay."""
    return sdf.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), by).agg(
        F.count("*").alias("n"), F.sum(value).alias(f"{value}_sum"), F.avg(value).alias(f"{value}_mean"))


def dedup_stream(sdf: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """Drop repeats of a key that arrive within the delay; older keys leave the state."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
