"""Inactivity sessions, for batches and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _islands(df: DataFrame, user: str, ts: str, gap_us: int) -> DataFrame:
    """Runs of a user's rows without a pause of ``gap_us`` or more: one row per (user, time bucket).

    Rows in the same bucket of one gap length always belong together, so a bucket is counted before
    anything is shuffled; a hot user shrinks to the buckets of the covered time span.
    """
    t = _micros(ts)
    buckets = df.groupBy(F.col(user), F.floor(t / gap_us).alias("_bucket")).agg(
        F.min(t).alias("_first"), F.max(t).alias("_last"), F.count("*").alias("_n"))
    w = Window.partitionBy(user).orderBy("_bucket")
    opens = F.coalesce(F.col("_first") - F.lag("_last").over(w) >= gap_us, F.lit(True)).cast("long")
    return buckets.withColumn("_opens", opens).withColumn("_island", F.sum("_opens").over(w))


def sessionize(df: DataFrame, user: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions of a batch: ``user, session_start, session_end, n``; a pause of the gap length ends one."""
    runs = _islands(df, user, ts, gap_seconds * 1_000_000).groupBy(user, "_island").agg(
        F.min("_first").alias("_a"), F.max("_last").alias("_b"), F.sum("_n").alias("n"))
    return runs.select(user, F.timestamp_micros("_a").alias("session_start"), F.timestamp_micros("_b").alias("last_event"), "n")


def sessionize_stream(sdf: DataFrame, user: str, ts: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream; the window's end is the last event plus the gap."""
    return sdf.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), user).agg(F.count("*").alias("n")).select(
        user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")
