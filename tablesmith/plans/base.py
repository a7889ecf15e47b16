"""The registry of queries and small helpers that the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL that must give the same rows."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, *cols: str) -> DataFrame:
    """Round the named columns, or all doubles, so that sums in another order compare equal."""
    names = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in names})


def day_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def time_text(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# --- tables with missing values -----------------------------------------------------------------
# The given tables hold no nulls. These versions blank cells by a rule on the key, the same in SQL.

GAPPY_ORDERS_SQL = """
gappy AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 5 < 3 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders)
"""


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(k % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(k % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(k % 5 >= 3, F.col("o_orderpriority")).alias("o_orderpriority"))


def nan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``gappy_orders`` with NaN in place of every missing price: all operators take both for missing."""
    return gappy_orders(spark, sf_dir).withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(float("nan"))))


# --- the event table read as an audit log ---------------------------------------------------------

AUDIT_SQL = """
audit AS (
  SELECT event_id, ts, user_id, value,
         CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'purchase' THEN 'data_exported'
              WHEN 'signup' THEN 'user_created' WHEN 'view' THEN 'data_accessed' ELSE 'access_denied' END AS event_type,
         CASE event_type WHEN 'error' THEN 'failure' WHEN 'click' THEN 'error' ELSE 'success' END AS outcome,
         CASE WHEN value > 100 THEN 'critical' WHEN value > 60 THEN 'high'
              WHEN value > 30 THEN 'medium' ELSE 'low' END AS risk_level
  FROM events)
"""


def as_audit(events: DataFrame) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    return events.select(
        "event_id", "ts", "user_id", "value",
        F.when(t == "error", "login_failed").when(t == "purchase", "data_exported").when(t == "signup", "user_created")
        .when(t == "view", "data_accessed").otherwise("access_denied").alias("event_type"),
        F.when(t == "error", "failure").when(t == "click", "error").otherwise("success").alias("outcome"),
        F.when(v > 100, "critical").when(v > 60, "high").when(v > 30, "medium").otherwise("low").alias("risk_level"))


def audit_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_audit(table(spark, sf_dir, "events"))


def newest(df: DataFrame, ts: str = "ts") -> Column:
    """The largest time stamp as a literal: stands in for the wall clock."""
    return F.lit(df.agg(F.max(ts)).first()[0])


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
