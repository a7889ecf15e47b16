"""Streaming queries: the event table is replayed as a stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import regression
from tablesmith.plans.base import AUDIT_SQL, as_audit, query, rounded, table, time_text
from tablesmith.plans.rules import TAINTED_SQL, full_sql, tainted
from tablesmith.session import scratch_path
from tablesmith.streaming import events as ev, jobs, sessions

A = f"WITH {AUDIT_SQL}"


def replay(spark, sf, name="events", ts="ts"):
    return ev.table_stream(spark, sf, name, table(spark, sf, name).schema).withColumn(ts, F.col(ts).cast("timestamp"))


def audit_replay(spark, sf):
    return as_audit(replay(spark, sf))


COUNTS = """count(*) AS total_events, count(*) FILTER (WHERE risk_level IN ('high', 'critical')) AS security_events,
count(*) FILTER (WHERE event_type = 'login_failed') AS failed_logins, count(*) FILTER (WHERE event_type = 'access_denied') AS access_denials"""


@query("stream_audit_ingest", f"""{A}, s AS (SELECT CASE WHEN risk_level = 'critical' THEN 'CRITICAL' WHEN outcome = 'error' OR event_type IN ('login_failed', 'access_denied') THEN 'ERROR'
WHEN risk_level IN ('medium', 'high') THEN 'WARNING' ELSE 'INFO' END AS severity FROM audit)
SELECT 'audit' AS sink, severity, count(*) AS n FROM s GROUP BY 2 UNION ALL
SELECT 'security', severity, count(*) FROM s WHERE severity <> 'INFO' GROUP BY 2""")
def stream_audit_ingest(spark, sf):
    a, b = scratch_path(spark, "audit"), scratch_path(spark, "security")
    jobs.audit_stream(audit_replay(spark, sf), a, b)
    count = lambda name, path: spark.read.parquet(path).groupBy("severity").agg(F.count("*").alias("n")).select(
        F.lit(name).alias("sink"), "severity", "n")
    return count("audit", a).unionByName(count("security", b))


#: Events arrive in so many spans of time; the job is started anew for each.
SLICES = 4
DELAY = "1 hour"


def timed(spark, sf, build, mode="append", keys=None, progress=None):
    """The event table through ``build``, slice by slice, with state carried from run to run."""
    df = table(spark, sf, "events")
    return ev.arriving(ev.time_slices(df, "ts", SLICES), build, mode, "ts", keys, progress=progress)


def closed(sql, end):
    """``sql``'s windows that the last watermark closes."""
    return f"SELECT * FROM ({sql}) WHERE strptime(window_start, '%Y-%m-%d %H:%M:%S') + {end} <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


def _windows(df):
    return df.select(time_text("w.start").alias("window_start"), "total_events", "security_events", "failed_logins", "access_denials")


@query("stream_tumbling_security", closed(
    f"{A} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, {COUNTS} FROM audit GROUP BY 1", "INTERVAL 1 DAY"))
def stream_tumbling_security(spark, sf, progress=None):
    return _windows(timed(spark, sf, lambda s: ev.security_windows(ev.with_lateness(as_audit(s), "ts", DELAY), "1 day"), progress=progress))


@query("stream_sliding_security", closed(f"""{A} SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(h AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start, {COUNTS}
FROM audit, (SELECT unnest(range(24)) AS h) GROUP BY 1""", "INTERVAL 24 HOUR"))
def stream_sliding_security(spark, sf, progress=None):
    return _windows(timed(spark, sf, lambda s: ev.security_windows(ev.with_lateness(as_audit(s), "ts", DELAY), "24 hours", "1 hour"), progress=progress))


@query("sliding_security_batch", f"""{A} SELECT strftime(date_trunc('hour', ts) - to_hours(CAST(h AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start, {COUNTS}
FROM audit, (SELECT unnest(range(24)) AS h) GROUP BY 1""")
def sliding_security_batch(spark, sf):
    return _windows(ev.security_windows(as_audit(table(spark, sf, "events")), "24 hours", "1 hour"))


SESSIONS_SQL = """
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts){}, '%Y-%m-%d %H:%M:%S') AS {}, count(*) AS n
FROM s GROUP BY user_id, sid"""


@query("stream_sessions", SESSIONS_SQL.format(" + INTERVAL 30 MINUTE", "session_end")
       + " HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_sessions(spark, sf, progress=None):
    s = timed(spark, sf, lambda e: sessions.sessionize_stream(e, "user_id", "ts", "30 minutes", DELAY), progress=progress)
    return s.withColumns({c: time_text(c) for c in ("session_start", "session_end")})


@query("sessions_batch", SESSIONS_SQL.format("", "last_event"))
def sessions_batch(spark, sf):
    s = sessions.sessionize(table(spark, sf, "events"), "user_id", "ts", 1800)
    return s.withColumns({c: time_text(c) for c in ("session_start", "last_event")})


CALLS = 3
BURSTS_SQL = f"""SELECT user_id, strftime(date_trunc('hour', ts) - to_hours(CAST(h AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS window_start,
count(*) AS calls, count(*) > {CALLS} AS over_limit FROM events, (SELECT unnest(range(6)) AS h) WHERE user_id IS NOT NULL GROUP BY 1, 2"""


def _bursts(df):
    return df.select("user_id", time_text("w.start").alias("window_start"), "calls", "over_limit")


@query("call_bursts_batch", BURSTS_SQL)
def call_bursts_batch(spark, sf):
    return _bursts(ev.call_bursts(table(spark, sf, "events"), "ts", "user_id", CALLS, "6 hours", "1 hour"))


@query("stream_call_bursts", closed(BURSTS_SQL, "INTERVAL 6 HOUR"))
def stream_call_bursts(spark, sf, progress=None):
    return _bursts(timed(spark, sf, lambda s: ev.call_bursts(ev.with_lateness(s, "ts", DELAY), "ts", "user_id", CALLS, "6 hours", "1 hour"), progress=progress))


@query("stream_dedup", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def stream_dedup(spark, sf, progress=None):
    """Events that are delivered twice: each slice comes again, in part, with the next one."""
    parts = ev.time_slices(table(spark, sf, "events"), "ts", SLICES)
    again = [parts[0].unionAll(parts[0].where("event_id % 3 = 0")), *[b.unionAll(a.where("event_id % 2 = 0")) for a, b in zip(parts, parts[1:])]]
    seen = ev.arriving(again, lambda s: ev.dedup_stream(s, ["event_id"], "ts", DELAY), ts="ts", progress=progress)
    return seen.select("event_id", time_text("ts").alias("ts"))


@query("stream_dedup_documents", "SELECT DISTINCT md5(text) AS content_hash FROM documents")
def stream_dedup_documents(spark, sf):
    docs = ev.table_stream(spark, sf, "documents", table(spark, sf, "documents").schema)
    # The documents carry no time; one time stamp for all keeps every hash inside the delay.
    hashed = docs.select(F.md5(F.col("text").cast("binary")).alias("content_hash"), F.lit("2024-01-01").cast("timestamp").alias("seen"))
    return ev.drained(ev.dedup_stream(hashed, ["content_hash"], "seen", "1 day")).select("content_hash")


@query("stream_late_data", """
WITH c AS (SELECT quantile_disc(ts, 0.5) AS cut, max(ts) AS top FROM events)
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events, c
WHERE ts >= cut AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= top - INTERVAL 1 HOUR GROUP BY 1""")
def stream_late_data(spark, sf):
    # The younger half arrives first, in two files; everything in the older half is then too late.
    df = table(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cut = df.select(micros.alias("t")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY t)")).first()[0]
    folder = scratch_path(spark, "late")
    parts = [(micros >= cut) & (F.col("event_id") % 2 == 0), (micros >= cut) & (F.col("event_id") % 2 == 1), micros < cut]
    for i, condition in enumerate(parts):
        df.where(condition).coalesce(1).write.parquet(f"{folder}/part={i}")
    stream = ev.event_stream(spark, f"{folder}/part=*", df.schema, files_per_batch=1)
    hourly = ev.with_lateness(stream, "ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return ev.drained(hourly).select(time_text("w.start").alias("window_start"), "n")


@query("stream_file_ingest", f"WITH {TAINTED_SQL} SELECT doc_id, lang, {full_sql('text')} AS text, true AS is_valid FROM tainted")
def stream_file_ingest(spark, sf):
    folder = scratch_path(spark, "uploads")
    upload = tainted(spark, sf)
    upload.write.parquet(folder)
    return ev.drained(jobs.ingest_stream(spark, folder, upload.schema, required=["doc_id", "text"]))


def _uploads(spark, sf):
    """Documents with missing and blank texts, in three deliveries."""
    d, k = tainted(spark, sf), F.col("doc_id")
    text = F.when(k % 7 == 0, F.lit(None)).when(k % 11 == 0, F.lit("  ")).otherwise(F.col("text"))
    lang = F.when(k % 13 == 0, F.lit(None)).otherwise(F.col("lang"))
    d = d.select("doc_id", lang.alias("lang"), text.alias("text"))
    return [d.where(k % 3 == i) for i in range(3)]


UPLOADS_SQL = f"""{TAINTED_SQL}, u AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN lang END AS lang,
CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN '  ' ELSE text END AS text FROM tainted),
c AS (SELECT doc_id, lang, {full_sql('text')} AS text FROM u),
j AS (SELECT *, list_filter([CASE WHEN lang IS NULL THEN 'missing lang' END, CASE WHEN trim(lang) = '' THEN 'blank lang' END,
CASE WHEN text IS NULL THEN 'missing text' END, CASE WHEN trim(text) = '' THEN 'blank text' END], lambda x: x IS NOT NULL) AS r FROM c)"""


def _ingested(spark, sf):
    job = jobs.CheckedIngest(scratch_path(spark, "ingested"), ["doc_id", "lang", "text"])
    ev.arriving(_uploads(spark, sf), job.judged, each=job.write)
    return job


@query("stream_ingest_accepted", f"WITH {UPLOADS_SQL} SELECT doc_id, lang, text FROM j WHERE len(r) = 0")
def stream_ingest_accepted(spark, sf):
    return _ingested(spark, sf).accepted(spark)


@query("stream_ingest_refused", f"WITH {UPLOADS_SQL} SELECT doc_id, lang, text, array_to_string(r, '; ') AS reasons FROM j WHERE len(r) > 0")
def stream_ingest_refused(spark, sf):
    return _ingested(spark, sf).refused(spark).withColumn("reasons", F.array_join("reasons", "; "))


@query("stream_rollup", """SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n,
round(sum(value), 2) AS value_sum, round(avg(value), 8) AS value_mean FROM events GROUP BY 1, 2""")
def stream_rollup(spark, sf):
    out = timed(spark, sf, lambda s: ev.rollup_stream(s, "ts", "value", "event_type"), "update", ["w", "event_type"])
    out = out.select(time_text("w.start").alias("window_start"), "event_type", "n", "value_sum", "value_mean")
    return rounded(rounded(out, 2, "value_sum"), 8, "value_mean")


@query("stream_score", """WITH m AS (SELECT regr_slope(o_totalprice, o_custkey) AS s, regr_intercept(o_totalprice, o_custkey) AS i FROM orders)
SELECT o_orderkey, round(i + s * o_custkey, 2) AS prediction FROM orders, m""")
def stream_score(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    model = regression.fit(orders, "o_totalprice", ["o_custkey"]).model
    arriving = ev.table_stream(spark, sf, "orders", table(spark, sf, "orders").schema).select(*orders.columns)
    return rounded(ev.drained(jobs.score_stream(model, arriving)).select("o_orderkey", "prediction"), 2, "prediction")


@query("stream_notifications", f"""{A} SELECT event_id, 'dataset_processed' AS kind, 'export by user ' || user_id AS message FROM audit WHERE event_type = 'data_exported'
UNION ALL SELECT event_id, 'system_alert', 'critical ' || event_type FROM audit WHERE risk_level = 'critical'""")
def stream_notifications(spark, sf):
    rules = {
        "dataset_processed": (F.col("event_type") == "data_exported", F.concat(F.lit("export by user "), F.col("user_id").cast("string"))),
        "system_alert": (F.col("risk_level") == "critical", F.concat(F.lit("critical "), F.col("event_type"))),
    }
    return ev.drained(jobs.notifications(audit_replay(spark, sf), rules)).select("event_id", "kind", "message")
