"""Audit-log analytics: severity, filters, summaries, access checks, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesmith.functions.formats import label_map
from tablesmith.operators.ordering import is_small

# Event names, operations, roles and permissions of the audit contract.
CRITICAL_EVENTS = ["malware_detected", "security_violation"]
ERROR_EVENTS = ["login_failed", "access_denied"]
WARNING_EVENTS = ["token_expired", "rate_limit_exceeded", "suspicious_activity"]
OPERATION_EVENTS = {
    "upload": "data_uploaded",
    "read": "data_accessed",
    "modify": "data_modified",
    "delete": "data_deleted",
    "export": "data_exported",
}
DEFAULT_OPERATION_EVENT = "data_accessed"
ROLE_PERMISSIONS = {
    "viewer": ["read_data", "view_models"],
    "analyst": ["read_data", "upload_data", "export_data", "view_models", "train_models", "use_models"],
    "admin": [
        "read_data", "upload_data", "delete_data", "export_data", "view_models", "train_models", "use_models",
        "delete_models", "manage_users", "view_audit_logs",
    ],
    "super_admin": [
        "read_data", "upload_data", "delete_data", "export_data", "view_models", "train_models", "use_models",
        "delete_models", "manage_users", "view_audit_logs", "system_config",
    ],
}
ACTION_PERMISSIONS = {
    ("data", "read"): "read_data",
    ("data", "upload"): "upload_data",
    ("data", "delete"): "delete_data",
    ("data", "export"): "export_data",
    ("model", "view"): "view_models",
    ("model", "train"): "train_models",
    ("model", "delete"): "delete_models",
    ("user", "manage"): "manage_users",
    ("audit", "view"): "view_audit_logs",
    ("system", "config"): "system_config",
}


def severity(risk: Column, outcome: Column, event_type: Column) -> Column:
    """CRITICAL, ERROR, WARNING or INFO; the first rule that applies decides."""
    return (
        F.when((risk == "critical") | event_type.isin(CRITICAL_EVENTS), "CRITICAL")
        .when((outcome == "error") | event_type.isin(ERROR_EVENTS), "ERROR")
        .when(risk.isin("medium", "high") | event_type.isin(WARNING_EVENTS), "WARNING")
        .otherwise("INFO")
    )


def severity_sql(risk: str, outcome: str, event_type: str) -> str:
    names = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return (
        f"CASE WHEN {risk} = 'critical' OR {event_type} IN ({names(CRITICAL_EVENTS)}) THEN 'CRITICAL' "
        f"WHEN {outcome} = 'error' OR {event_type} IN ({names(ERROR_EVENTS)}) THEN 'ERROR' "
        f"WHEN {risk} IN ('medium', 'high') OR {event_type} IN ({names(WARNING_EVENTS)}) THEN 'WARNING' "
        "ELSE 'INFO' END"
    )


def map_operation(operation: Column) -> Column:
    return F.coalesce(label_map(operation, OPERATION_EVENTS), F.lit(DEFAULT_OPERATION_EVENT))


def audit_where(df: DataFrame, user=None, event_type=None, risk=None, start=None, end=None) -> DataFrame:
    """All given conditions; they reach the scan as pushed filters."""
    if user is not None:
        df = df.where(F.col("user_id") == F.lit(user))
    if event_type is not None:
        df = df.where(F.col("event_type") == event_type)
    if risk is not None:
        df = df.where(F.col("risk_level") == risk)
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end))
    return df


def audit_query(df: DataFrame, limit: int = 100, offset: int = 0, **conditions) -> DataFrame:
    """One page of matching events, newest first."""
    return audit_where(df, **conditions).orderBy(F.desc("ts"), F.desc("event_id")).offset(offset).limit(limit)


def audit_count(df: DataFrame, **conditions) -> DataFrame:
    return audit_where(df, **conditions).agg(F.count("*").alias("n"))


def trailing_hours(df: DataFrame, now: Column, hours: int) -> DataFrame:
    return df.where(F.col("ts") >= now - F.make_dt_interval(hours=F.lit(hours)))


def security_summary(df: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Counts over the trailing hours; every event counts."""
    return trailing_hours(df, now, hours).agg(
        F.count("*").alias("total_events"),
        F.count_if(F.col("risk_level").isin("high", "critical")).alias("security_events"),
        F.count_if(F.col("event_type") == "login_failed").alias("failed_logins"),
        F.count_if(F.col("event_type") == "access_denied").alias("access_denials"),
        F.lit(hours).alias("period_hours"))


def risky_events(df: DataFrame, now: Column, hours: int = 24, n: int = 10) -> DataFrame:
    """The newest high and critical events of the trailing hours."""
    risky = trailing_hours(df, now, hours).where(F.col("risk_level").isin("high", "critical"))
    return risky.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def keep_last(df: DataFrame, n: int, order: str, key: str, by: str | None = None) -> DataFrame:
    """The newest ``n`` rows, overall or per group.

    Overall is a top-n (each task keeps n rows). Per group, the rank filter also runs before the
    shuffle, so a hot group sends at most n rows per task.
    """
    newest = [F.desc(order), F.desc(key)]
    if by is None:
        return df.orderBy(*newest).limit(n)
    w = Window.partitionBy(by).orderBy(*newest)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def role_permission_table(spark, roles: dict[str, list[str]] = ROLE_PERMISSIONS) -> DataFrame:
    return spark.createDataFrame([(r, p) for r, ps in roles.items() for p in ps], "role string, permission string")


def action_permission_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(r, a, p) for (r, a), p in ACTION_PERMISSIONS.items()], "resource string, action string, permission string")


def access_audit(events: DataFrame, users: DataFrame, user: str = "user_id", small_users: int = 1_000_000) -> DataFrame:
    """Was each action allowed for the user's role? Unknown actions, roles and users are not.

    ``events`` has the user, ``resource`` and ``action``; ``users`` has the user and ``role``. The two
    fixed matrices have a few dozen rows. Users are broadcast only while their counted number is
    small; otherwise the join shuffles and adaptive execution splits hot users.
    """
    spark = events.sparkSession
    role_side = users.select(user, "role")
    if is_small(role_side, small_users):
        role_side = F.broadcast(role_side)
    needed = F.broadcast(action_permission_table(spark))
    granted = F.broadcast(role_permission_table(spark).withColumn("_granted", F.lit(True)))
    return (
        events.join(role_side, user, "left")
        .join(needed, ["resource", "action"], "left")
        .join(granted, ["role", "permission"], "left")
        .withColumn("allowed", F.coalesce("_granted", F.lit(False)))
        .drop("_granted")
    )


def active_sessions(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))


def expired_sessions(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("is_active") & F.col("expires_at").isNotNull() & (F.col("expires_at") <= now))


def expired_files(manifest: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    return manifest.where(F.col("modified") < now - F.make_dt_interval(hours=F.lit(hours)))


def task_health(jobs: DataFrame) -> DataFrame:
    """Success rate of finished tasks, ``degraded`` at 80 % or less. Needs a ``status`` column."""
    done = F.col("succeeded") + F.col("failed")
    return jobs.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "success").alias("succeeded"),
        F.count_if(F.col("status") == "failure").alias("failed"),
    ).select(
        "total", "succeeded", "failed", (F.col("total") - done).alias("pending"),
        F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("succeeded"), done), 2), F.lit(0.0)).alias("success_rate"),
        F.when(done == 0, "healthy").when(F.try_divide(F.col("succeeded"), done) > 0.8, "healthy")
        .otherwise("degraded").alias("status"))


def cache_health(df: DataFrame, hits: Column, misses: Column, errors: Column, entries: Column) -> DataFrame:
    """Hit rate and health score from request outcomes (boolean columns) and the entry count."""
    n = df.agg(
        F.count_if(hits).alias("hits"), F.count_if(misses).alias("misses"), F.count_if(errors).alias("errors"),
        entries.alias("entries"))
    requests = F.col("hits") + F.col("misses")
    scored = n.withColumn("total_requests", requests).withColumn(
        "hit_rate", F.coalesce(F.round(F.try_divide(F.lit(100.0) * F.col("hits"), requests), 2), F.lit(0.0)))
    penalty = (
        F.when(F.col("hit_rate") < 50, 30).when(F.col("hit_rate") < 70, 15).otherwise(0)
        + F.when(F.col("errors") > F.col("total_requests") * 0.05, 25).otherwise(0)
        + F.when(F.col("entries") > 5000, 10).otherwise(0)
    )
    scored = scored.withColumn("health_score", F.greatest(F.lit(0), F.lit(100) - penalty))
    return scored.withColumn("status", F.when(F.col("health_score") >= 80, "healthy")
                             .when(F.col("health_score") >= 60, "degraded").otherwise("unhealthy"))
