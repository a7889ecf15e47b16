"""Streams over several runs: windows close once, state leaves, repeats and refused rows end where they should."""

from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tablesmith.plans import streams
from tablesmith.session import scratch_path
from tablesmith.streaming import events as ev, jobs

START = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(k, u, START + timedelta(minutes=m)) for k, u, m in rows], "k int, u int, ts timestamp")


def state(progress):
    """(rows that came in, rows kept at the end, most rows kept at once, rows that left) of the stateful operators."""
    ops = [[o["numRowsTotal"], o["numRowsRemoved"]] for p in progress for o in p["stateOperators"][-1:]]
    return sum(p["numInputRows"] for p in progress), ops[-1][0], max(o[0] for o in ops), sum(o[1] for o in ops)


@pytest.mark.parametrize("query", [streams.stream_tumbling_security, streams.stream_sliding_security, streams.stream_sessions, streams.stream_dedup])
def test_state_leaves(spark, sf, query):
    progress = []
    rows = query(spark, sf, progress=progress).count()
    came, left_over, most, gone = state(progress)
    assert len([p for p in progress if p["numInputRows"]]) >= 3
    assert gone > 0 and left_over <= most < rows + left_over
    assert left_over < rows / 2


def test_windows_close_once_over_runs(spark):
    slices = [frame(spark, [(i, 1, m) for i, m in enumerate(range(d * 600, d * 600 + 600, 30))]) for d in range(4)]
    out = ev.arriving(slices, lambda s: ev.pane_windows(ev.with_lateness(s, "ts", "1 hour"), "ts", {"n": F.lit(1)}, "4 hours", "1 hour"), ts="ts")
    got = {r.w.start: r.n for r in out.collect()}
    assert len(got) == out.count()
    last = max(m for d in range(4) for m in range(d * 600, d * 600 + 600, 30))
    want = {}
    for h in range(-3, 40):
        n = sum(1 for m in range(0, 2400, 30) if h * 60 <= m < h * 60 + 240)
        if n and (h + 4) * 60 <= last - 60:
            want[START + timedelta(hours=h)] = n
    assert got == want


def test_rows_are_counted_once_before_windows(spark):
    """The plan copies panes, never events: the only expansion stands behind the first aggregate."""
    plan = ev.pane_windows(frame(spark, [(1, 1, 1)]), "ts", {"n": F.lit(1)}, "24 hours", "1 hour")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    expand = [i for i, x in enumerate(lines) if "Expand" in x or "Generate" in x]
    aggregates = [i for i, x in enumerate(lines) if "Aggregate" in x]
    assert expand and len(aggregates) == 2 and aggregates[0] < min(expand) and max(expand) < aggregates[1]


def test_repeats_over_runs_and_late_rows(spark):
    first = [(1, 1, 0), (2, 1, 10), (2, 1, 10)]
    second = [(2, 1, 10), (3, 1, 40), (4, 1, 300)]
    third = [(4, 1, 300), (5, 1, 301), (1, 1, 0)]
    out = ev.arriving([frame(spark, x) for x in (first, second, third)], lambda s: ev.dedup_stream(s, ["k"], "ts", "1 hour"), ts="ts")
    assert sorted(r.k for r in out.collect()) == [1, 2, 3, 4, 5]


def test_call_bursts(spark):
    df = frame(spark, [(i, 1, m) for i, m in enumerate([0, 5, 10, 15, 200])] + [(9, 2, 0), (10, None, 0)])
    got = {(r.u, r.w.start): (r.calls, r.over_limit) for r in ev.call_bursts(df, "ts", "u", 3, "1 hour", "30 minutes").collect()}
    assert got[(1, START)] == (4, True) and got[(1, START + timedelta(minutes=180))] == (1, False) and got[(2, START)] == (1, False)
    assert all(u is not None for u, _ in got)
    assert ev.call_bursts(df.limit(0), "ts", "u", 3, "1 hour", "30 minutes").count() == 0


def test_time_slices_keep_every_row(spark):
    df = frame(spark, [(i, 1, i * i) for i in range(20)]).unionAll(spark.createDataFrame([(99, 1, None)], "k int, u int, ts timestamp"))
    parts = ev.time_slices(df, "ts", 3)
    assert sorted(r.k for p in parts for r in p.collect()) == [*range(20), 99]
    assert ev.time_slices(df.limit(0), "ts", 3)[0].count() == 0


def test_refused_rows(spark):
    job = jobs.CheckedIngest(scratch_path(spark, "ingested"), ["k", "t"], max_chars=5)
    schema = "k int, t string, x double, extra string"
    days = [[(1, "fine", 1.0, None), (2, " ", 1.0, None)], [(None, None, float("nan"), "a"), (4, "longer", 2.0, "b")], [(5, "<b>ok", float("inf"), "c")]]
    ev.arriving([spark.createDataFrame(d, schema) for d in days], job.judged, each=job.write)
    refused = {r.k: r.reasons for r in job.refused(spark).collect()}
    assert [r.k for r in job.accepted(spark).collect()] == [1]
    assert refused[2] == ["blank t"] and refused[None] == ["missing k", "missing t", "not finite x"] and refused[4] == ["too long t"]
    assert "not finite x" in refused[5]
    # A batch that runs again leaves no doubles.
    again = spark.createDataFrame(days[0], schema)
    job.write(job.judged(again), 0)
    assert [r.k for r in job.accepted(spark).collect()] == [1]


def test_tables_as_files_and_folders(spark, tmp_path):
    """Small tables are one file, larger ones a folder of files; other tables beside them stay out."""
    rows = spark.createDataFrame([(i, f"text {i % 5}") for i in range(20)], "doc_id long, text string")
    folder, single = str(tmp_path / "folder"), str(tmp_path / "single")
    rows.repartition(3).write.parquet(f"{folder}/documents.parquet")
    rows.write.parquet(f"{folder}/more_documents.parquet")
    (tmp_path / "single").mkdir()
    for name in ("documents", "more_documents"):
        pq.write_table(rows.toArrow(), f"{single}/{name}.parquet")
    for place in (folder, single):
        assert streams.stream_dedup_documents(spark, place).count() == 5
        assert ev.drained(ev.table_stream(spark, place, "documents", rows.schema)).count() == 20
    events = spark.createDataFrame([(1, "export", 1, 200.0, START), (2, "purchase", 2, 1.0, START)], "event_id int, event_type string, user_id int, value double, ts timestamp")
    events.repartition(2).write.parquet(f"{folder}/events.parquet")
    assert sorted((r.event_id, r.kind) for r in streams.stream_notifications(spark, folder).collect()) == [(1, "system_alert"), (2, "dataset_processed")]
