"""Compare a Spark result with the rows DuckDB gives for the check SQL."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else float(v)
    return str(v)


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((c is None, str(type(c)), c if c is not None else 0) for c in r))


def mismatch(df, con, sql: str, tol: float = 0.0) -> str | None:
    """None when equal, otherwise what differs first."""
    rel = con.execute(sql)
    want_names, want = _sorted([d[0] for d in rel.description], rel.fetchall())
    got_names, got = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = 0
    first = ""
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            same = a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=tol, abs_tol=tol))
            if not same:
                bad += 1
                first = first or f"{g} != {w}"
                break
    return f"{bad} rows differ, first: {first}"[:600] if bad else None
