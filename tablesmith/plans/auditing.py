"""Audit-log queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import audit
from tablesmith.plans.base import AUDIT_SQL, audit_table, newest, query, table, time_text

A = f"WITH {AUDIT_SQL}"
DAY = "ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR"


@query("audit_filter", f"""{A} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, risk_level FROM audit
WHERE event_type = 'login_failed' AND risk_level = 'high' AND audit.ts >= TIMESTAMP '2024-01-03' AND audit.ts <= TIMESTAMP '2024-02-20'
ORDER BY audit.ts DESC, event_id DESC LIMIT 30 OFFSET 5""")
def audit_filter(spark, sf):
    start, end = (F.to_timestamp_ntz(F.lit(d)) for d in ("2024-01-03 00:00:00", "2024-02-20 00:00:00"))
    out = audit.audit_query(audit_table(spark, sf), 30, 5, event_type="login_failed", risk="high", start=start, end=end)
    return out.select("event_id", time_text("ts").alias("ts"), "user_id", "risk_level")


@query("audit_filtered_count", f"{A} SELECT count(*) AS n FROM audit WHERE user_id = 8 AND event_type = 'data_accessed'")
def audit_filtered_count(spark, sf):
    return audit.audit_count(audit_table(spark, sf), user=8, event_type="data_accessed")


@query("event_severity", f"{A} SELECT event_id, {audit.severity_sql('risk_level', 'outcome', 'event_type')} AS severity FROM audit")
def event_severity(spark, sf):
    return audit_table(spark, sf).select(
        "event_id", audit.severity(F.col("risk_level"), F.col("outcome"), F.col("event_type")).alias("severity"))


@query("event_type_map", """SELECT event_id, CASE op WHEN 'upload' THEN 'data_uploaded' WHEN 'read' THEN 'data_accessed' WHEN 'modify' THEN 'data_modified'
WHEN 'delete' THEN 'data_deleted' WHEN 'export' THEN 'data_exported' ELSE 'data_accessed' END AS mapped FROM
(SELECT event_id, CASE event_type WHEN 'signup' THEN 'upload' WHEN 'view' THEN 'read' WHEN 'click' THEN 'modify' WHEN 'error' THEN 'delete'
 ELSE 'something_else' END AS op FROM events)""")
def event_type_map(spark, sf):
    t = F.col("event_type")
    op = (F.when(t == "signup", "upload").when(t == "view", "read").when(t == "click", "modify").when(t == "error", "delete")
          .otherwise("something_else"))
    return table(spark, sf, "events").select("event_id", audit.map_operation(op).alias("mapped"))


@query("security_summary", f"""{A} SELECT count(*) AS total_events, count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS security_events,
count(*) FILTER (WHERE event_type = 'login_failed') AS failed_logins, count(*) FILTER (WHERE event_type = 'access_denied') AS access_denials,
24 AS period_hours FROM audit WHERE {DAY}""")
def security_summary(spark, sf):
    df = audit_table(spark, sf)
    return audit.security_summary(df, newest(df))


@query("security_risky_events", f"""{A} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, risk_level FROM audit
WHERE risk_level IN ('high', 'critical') AND audit.{DAY} ORDER BY audit.ts DESC, event_id DESC LIMIT 10""")
def security_risky_events(spark, sf):
    df = audit_table(spark, sf)
    return audit.risky_events(df, newest(df)).select("event_id", time_text("ts").alias("ts"), "risk_level")


@query("keep_last_n", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 5000")
def keep_last_n(spark, sf):
    return audit.keep_last(table(spark, sf, "events"), 5000, "ts", "event_id").select("event_id", "user_id")


@query("keep_last_n_per_user", """SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r
FROM events) WHERE r <= 5""")
def keep_last_n_per_user(spark, sf):
    return audit.keep_last(table(spark, sf, "events"), 5, "ts", "event_id", by="user_id").select("event_id", "user_id")


def _grants_sql():
    roles = ", ".join(f"('{r}', '{p}')" for r, ps in audit.ROLE_PERMISSIONS.items() for p in ps)
    actions = ", ".join(f"('{r}', '{a}', '{p}')" for (r, a), p in audit.ACTION_PERMISSIONS.items())
    return f"grants(role, permission) AS (VALUES {roles}), needs(resource, action, permission) AS (VALUES {actions})"


@query("access_audit", f"""
WITH {_grants_sql()},
acts AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'model' WHEN 'signup' THEN 'user' ELSE 'data' END AS resource,
  CASE event_type WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'manage' WHEN 'purchase' THEN 'export' WHEN 'view' THEN 'read' ELSE 'fly' END AS action FROM events),
users AS (SELECT c_custkey AS user_id, CASE c_nationkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'admin' ELSE 'super_admin' END AS role FROM customer)
SELECT event_id, role, permission, EXISTS (SELECT 1 FROM grants g WHERE g.role = users.role AND g.permission = needs.permission) AS allowed
FROM acts LEFT JOIN users USING (user_id) LEFT JOIN needs USING (resource, action)""")
def access_audit(spark, sf):
    t = F.col("event_type")
    acts = table(spark, sf, "events").select(
        "event_id", "user_id", F.when(t == "error", "model").when(t == "signup", "user").otherwise("data").alias("resource"),
        F.when(t == "error", "delete").when(t == "signup", "manage").when(t == "purchase", "export").when(t == "view", "read")
        .otherwise("fly").alias("action"))
    r = F.col("c_nationkey") % 4
    users = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.when(r == 0, "viewer").when(r == 1, "analyst").when(r == 2, "admin").otherwise("super_admin").alias("role"))
    return audit.access_audit(acts, users).select("event_id", "role", "permission", "allowed")


SESSIONS_SQL = """sessions AS (SELECT event_id AS session_id, event_type <> 'error' AS is_active,
CASE WHEN event_id % 6 = 0 THEN NULL ELSE ts + to_hours(CAST(event_id % 48 AS INTEGER)) END AS expires_at FROM events),
clock AS (SELECT max(ts) AS now FROM events)"""


def _sessions(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("session_id"), (F.col("event_type") != "error").alias("is_active"),
        F.when(F.col("event_id") % 6 != 0, F.col("ts") + F.make_dt_interval(hours=(F.col("event_id") % 48).cast("int"))).alias("expires_at"))


@query("expired_sessions", f"""WITH {SESSIONS_SQL} SELECT session_id, 'active' AS state FROM sessions, clock
WHERE is_active AND (expires_at IS NULL OR expires_at > now)
UNION ALL SELECT session_id, 'expired' FROM sessions, clock WHERE is_active AND expires_at <= now""")
def expired_sessions(spark, sf):
    s = _sessions(spark, sf)
    now = newest(table(spark, sf, "events"))
    return audit.active_sessions(s, now).select("session_id", F.lit("active").alias("state")).unionByName(
        audit.expired_sessions(s, now).select("session_id", F.lit("expired").alias("state")))


@query("expired_files", """SELECT event_id AS file_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS modified FROM events
WHERE events.ts < (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def expired_files(spark, sf):
    manifest = table(spark, sf, "events").select(F.col("event_id").alias("file_id"), F.col("ts").alias("modified"))
    return audit.expired_files(manifest, newest(manifest, "modified")).withColumn("modified", time_text("modified"))


JOB_STATUS_SQL = "jobs AS (SELECT CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'pending' ELSE 'success' END AS status FROM events)"


@query("job_health", f"""WITH {JOB_STATUS_SQL}, c AS (SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS succeeded,
count(*) FILTER (WHERE status = 'failure') AS failed FROM jobs)
SELECT total, succeeded, failed, total - succeeded - failed AS pending, round(100.0 * succeeded / (succeeded + failed), 2) AS success_rate,
CASE WHEN succeeded * 1.0 / (succeeded + failed) > 0.8 THEN 'healthy' ELSE 'degraded' END AS status FROM c""")
def job_health(spark, sf):
    t = F.col("event_type")
    return audit.task_health(table(spark, sf, "events").select(
        F.when(t == "error", "failure").when(t == "signup", "pending").otherwise("success").alias("status")))


@query("cache_health", """WITH c AS (SELECT count(*) FILTER (WHERE event_type IN ('view', 'click')) AS hits,
count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS misses, count(*) FILTER (WHERE event_type = 'error') AS errors,
count(DISTINCT user_id) AS entries FROM events),
s AS (SELECT *, hits + misses AS total_requests, round(100.0 * hits / (hits + misses), 2) AS hit_rate FROM c),
p AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN hit_rate < 50 THEN 30 WHEN hit_rate < 70 THEN 15 ELSE 0 END
  - CASE WHEN errors > total_requests * 0.05 THEN 25 ELSE 0 END - CASE WHEN entries > 5000 THEN 10 ELSE 0 END) AS INTEGER) AS health_score FROM s)
SELECT *, CASE WHEN health_score >= 80 THEN 'healthy' WHEN health_score >= 60 THEN 'degraded' ELSE 'unhealthy' END AS status FROM p""")
def cache_health(spark, sf):
    t = F.col("event_type")
    return audit.cache_health(
        table(spark, sf, "events"), t.isin("view", "click"), t.isin("purchase", "signup"), t == "error", F.countDistinct("user_id"))


