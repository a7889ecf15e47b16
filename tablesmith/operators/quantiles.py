"""Exact linear-interpolated quantiles that never hold a whole column in one task.

Small groups (a checked size) use Spark's exact ``percentile``. Larger ones go through a selection by
counting: a pass counts the values of each column in equal bins between the current bounds, which tells
exactly in which bin a wanted rank lies; the bounds shrink to that bin until few enough rows are left to
be put in order. Counts are combined before the shuffle, so a pass moves bins, not rows. Values that
repeat end in a bin of their own, whatever their share of the rows.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tablesmith.session import settle

SMALL_GROUP = 100_000      # rows of one group that `percentile` may hold in one task
GATHER_ROWS = 1_000_000    # rows between the bounds that one task may put in order
BINS = 4096
ROUNDS = 60
SKETCH = 10_000            # sketch accuracy for approx=True: rank error at most n / SKETCH


def _number(df: DataFrame, c: str) -> Column:
    """The value as a double; NaN is missing and an infinity is the largest double of its sign."""
    v = F.col(c).cast("double")
    if not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return v
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.least(v, F.lit(sys.float_info.max)), F.lit(-sys.float_info.max)))


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(i).alias("_c"), _number(df, c).alias("_v")) for i, c in enumerate(cols)
    ])
    long = df.select(*by, F.explode(cells).alias("_x")).select(*by, "_x._c", "_x._v")
    keep = F.col("_v").isNotNull()
    for b in by:
        keep = keep & F.col(b).isNotNull()
    return long.where(keep)


def _name(cols: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("_c") + 1)


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    approx: bool = False,
    small_group: int = SMALL_GROUP,
    gather_rows: int = GATHER_ROWS,
    bins: int = BINS,
) -> DataFrame:
    """One row per group and column: ``*by, column, n, q`` with ``q[i]`` the quantile ``probs[i]``.

    Nulls (and null group keys) are left out. ``approx=True`` is a single sketch pass.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    keys = [*by, "_c"]
    long = _long(df, cols, by)
    prob_array = F.array(*[F.lit(p) for p in probs])
    out = [*by, _name(cols).alias("column"), "n", "q"]

    if approx:
        return long.groupBy(*keys).agg(
            F.count("_v").alias("n"), F.percentile_approx("_v", prob_array, F.lit(SKETCH)).alias("q")).select(*out)
    if not by:
        return _whole_columns(df, cols, probs, small_group, gather_rows, bins)
    sizes, few = settle(long.groupBy(*keys).agg(
        F.count("_v").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    if not sizes.where(F.col("n") > small_group).take(1):
        return long.groupBy(*keys).agg(F.count("_v").alias("n"), F.percentile("_v", prob_array).alias("q")).select(*out)
    return _select_ranks(long, sizes, few, keys, probs, gather_rows, bins).select(*out)


def _spread(v: Column, log: Column) -> Column:
    """The bin scale: linear, or signed logarithm where linear bins did not split the rows."""
    return F.when(log, F.signum(v) * F.log1p(F.abs(v))).otherwise(v)


def _bin(v: Column, lo: Column, hi: Column, log: Column, bins: int) -> Column:
    a, b = _spread(lo, log), _spread(hi, log)
    at = F.try_divide((_spread(v, log) - a) * bins, b - a)
    return F.least(F.floor(F.coalesce(at, F.lit(0.0))), F.lit(bins - 1)).cast("int")


# --- whole columns: the bounds are a few numbers per column, so they are literals in the next pass ---


@dataclass
class _Cell:
    """A run of a column's values: the bins that lead to it, the rows below it and in it."""

    col: str
    below: int
    rows: int
    path: list[tuple[float, float, bool, int]] = field(default_factory=list)
    parent_rows: int = 0
    value: float | None = None      # set when all its values are equal

    def holds(self, v: str, bins: int) -> str:
        return " AND ".join([f"{v} IS NOT NULL", *[f"{_bin_sql(v, lo, hi, log, bins)} = {at}" for lo, hi, log, at in self.path]])


def _bin_sql(v: str, lo: float, hi: float, log: bool, bins: int) -> str:
    """The bin of a value as SQL text: built once per column, it saves a driver call per sub-expression."""
    if log:
        v, lo, hi = f"signum({v}) * log1p(abs({v}))", *(math.copysign(math.log1p(abs(x)), x) for x in (lo, hi))
    return f"least(CAST(floor(({v} - ({lo!r}D)) * {bins / (hi - lo)!r}D) AS INT), {bins - 1})"


def _whole_columns(df, cols, probs, small_group, gather_rows, bins) -> DataFrame:
    spark = df.sparkSession
    bins = max(min(bins, 400_000 // max(len(cols), 1)), 2)
    data = df.select(*[_number(df, c).alias(f"_c{i}") for i, c in enumerate(cols)])
    v = {c: f"_c{i}" for i, c in enumerate(cols)}
    schema = "column string, n long, q array<double>"

    def bounds(cells: list[_Cell]) -> list[tuple]:
        within = [v[c.col] if not c.path else f"CASE WHEN {c.holds(v[c.col], bins)} THEN {v[c.col]} END" for c in cells]
        row = data.agg(*[F.expr(f"{fn}({x})") for x in within for fn in ("count", "min", "max")]).first()
        return [tuple(row[3 * i: 3 * i + 3]) for i in range(len(cells))]

    whole = [_Cell(c, 0, 0) for c in cols]
    extent = bounds(whole)
    if max(e[0] for e in extent) <= small_group:
        share = f"array({', '.join(f'{p!r}D' for p in probs)})"
        wide = data.agg(*[F.expr(f"percentile({v[c]}, {share})").alias(f"q{i}") for i, c in enumerate(cols)]).first()
        return spark.createDataFrame([(c, e[0], wide[f"q{i}"]) for i, (c, e) in enumerate(zip(cols, extent)) if e[0]], schema)

    sizes = {c: e[0] for c, e in zip(cols, extent) if e[0]}
    ranks = {c: sorted({r for p in probs for r in (math.floor((n - 1) * p), min(math.floor((n - 1) * p) + 1, n - 1))}) for c, n in sizes.items()}
    at: dict[tuple[str, int], _Cell] = {}
    todo = [(c, e) for c, e in zip(whole, extent) if e[0]]
    for cell, _ in todo:
        cell.rows = sizes[cell.col]
        at.update({(cell.col, r): cell for r in ranks[cell.col]})

    for _ in range(ROUNDS):
        split = []
        for cell, (_, lo, hi) in todo:
            if lo == hi:
                cell.value = lo
                continue
            # Linear bins; a logarithmic scale where the last linear ones did not spread the rows.
            last = cell.path[-1] if cell.path else None
            stuck = last is not None and not last[2] and cell.rows * 2 > cell.parent_rows
            split.append((cell, lo, hi, stuck or not math.isfinite((hi - lo) * bins) or not math.isfinite(bins / (hi - lo))))
        if not split:
            break
        # (Nulls are dropped after explode: that keeps the whole pass in generated code.)
        parts = ", ".join(
            f"CASE WHEN {c.holds(v[c.col], bins)} THEN {k * bins} + {_bin_sql(v[c.col], lo, hi, log, bins)} END"
            for k, (c, lo, hi, log) in enumerate(split))
        # What comes back is a count per bin: at most `bins` numbers for each of the cells.
        counts = sorted((r[0], r[1]) for r in data.selectExpr(f"explode(array({parts})) AS b").where("b IS NOT NULL").groupBy("b").count().collect())
        fresh = {}
        for k, (cell, lo, hi, log) in enumerate(split):
            below, mine = cell.below, [(b - k * bins, m) for b, m in counts if b // bins == k]
            wanted = [r for (c, r), x in at.items() if x is cell]
            for b, m in mine:
                inside = [r for r in wanted if below <= r < below + m]
                if inside:
                    child = _Cell(cell.col, below, m, [*cell.path, (lo, hi, log, b)], cell.rows)
                    at.update({(cell.col, r): child for r in inside})
                    if m > gather_rows:
                        fresh[id(child)] = child
                below += m
        if not fresh:
            break
        todo = list(zip(fresh.values(), bounds(list(fresh.values()))))
    else:
        raise RuntimeError("quantile bounds did not narrow")

    open_cells = list({id(c): c for c in at.values() if c.value is None}.values())
    values = {(c, r): cell.value for (c, r), cell in at.items() if cell.value is not None}
    if open_cells:
        # Cells of one column that share all bins but the last are tested together.
        families: dict[tuple, list[_Cell]] = {}
        for cell in open_cells:
            families.setdefault((cell.col, tuple(cell.path[:-1]), cell.path[-1][:3]), []).append(cell)
        hits, wanted = [], []
        for k, ((c, head, (lo, hi, log)), cells) in enumerate(families.items()):
            at_bin = _bin_sql(v[c], lo, hi, log, bins)
            inside = f"{_Cell(c, 0, 0, list(head)).holds(v[c], bins)} AND {at_bin} IN ({', '.join(str(x.path[-1][3]) for x in cells)})"
            hits.append(f"CASE WHEN {inside} THEN named_struct('k', {k}, 'b', {at_bin}, 'v', {v[c]}) END")
            wanted += [(k, x.path[-1][3], c, r, r - x.below) for x in cells for (_, r), y in at.items() if y is x]
        found = data.selectExpr(f"explode(array({', '.join(hits)})) AS _h").where("_h IS NOT NULL").groupBy("_h.k", "_h.b", "_h.v").agg(
            F.count("*").alias("m"))
        w = Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        places = spark.createDataFrame(wanted, "k int, b int, column string, rank long, place long")
        # `places` has a row per wanted rank.
        picked = found.withColumn("cum", F.sum("m").over(w)).join(F.broadcast(places), ["k", "b"]).where(F.col("cum") > F.col("place"))
        values.update({(r["column"], r["rank"]): r["v"] for r in picked.groupBy("column", "rank").agg(F.min("v").alias("v")).collect()})

    rows = []
    for c, n in sizes.items():
        q = []
        for p in probs:
            k = math.floor((n - 1) * p)
            a, b = values[c, k], values[c, min(k + 1, n - 1)]
            q.append(a + (b - a) * ((n - 1) * p - k))
        rows.append((c, n, q))
    return spark.createDataFrame(rows, schema)


# --- groups: the bounds are a table with one row per group and column --------------------------------


def _select_ranks(long, sizes, few, keys, probs, gather_rows, bins) -> DataFrame:
    # Two ranks per quantile: the ones on either side of its position. Each has bounds of its own.
    idx = range(2 * len(probs))

    def position(i: int) -> Column:
        return (F.col("n") - 1) * F.lit(probs[i // 2])

    def rank(i: int) -> Column:
        return F.least(F.floor(position(i)) + i % 2, F.col("n") - 1)

    def attach(state: DataFrame, small: bool) -> DataFrame:
        # A state row exists per group and column; it is broadcast only when settle() counted it.
        return long.join(F.broadcast(state) if small else state, keys)

    def settled(i: int) -> Column:
        return F.col(f"_lo{i}") == F.col(f"_hi{i}")

    def wide(i: int) -> Column:
        return ~settled(i) & (F.col(f"_in{i}") > gather_rows)

    # Per rank: bounds, rows below them (_lt), rows between them (_in), bin scale (_log).
    width_overflows = F.lit(bins) * (F.col("_hi") / 2 - F.col("_lo") / 2) > 1e307
    state = sizes.select(*keys, "n", *[c for i in idx for c in (
        F.col("_lo").alias(f"_lo{i}"), F.col("_hi").alias(f"_hi{i}"), F.lit(0).cast("long").alias(f"_lt{i}"),
        F.col("n").alias(f"_in{i}"), width_overflows.alias(f"_log{i}"))])

    for round_no in range(ROUNDS):
        base = attach(state, few)
        if round_no == 0:
            # All ranks share the same bounds: one bin per row.
            cells = base.withColumn("_bin", _bin(F.col("_v"), F.col("_lo0"), F.col("_hi0"), F.col("_log0"), bins))
            cell_keys = [*keys]
        else:
            hits = F.array(*[
                F.when(wide(i) & F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.struct(
                    F.lit(i).alias("i"),
                    _bin(F.col("_v"), F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_log{i}"), bins).alias("b")))
                for i in idx])
            cells = base.select(*keys, "_v", F.explode(hits).alias("_h")).where("_h IS NOT NULL").select(
                *keys, "_v", F.col("_h.i").alias("_i"), F.col("_h.b").alias("_bin"))
            cell_keys = [*keys, "_i"]
        counted = cells.groupBy(*cell_keys, "_bin").agg(
            F.count("*").alias("_m"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
        # At most `bins` rows per group, column and rank.
        w = Window.partitionBy(*cell_keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
        ladder = counted.withColumn("_cum", F.sum("_m").over(w)).join(state, keys)

        def own(i: int) -> Column:
            return F.lit(True) if round_no == 0 else F.col("_i") == i

        def upto(i: int) -> Column:
            return F.col(f"_lt{i}") + F.col("_cum")

        narrowed = ladder.groupBy(*keys).agg(*[c for i in idx for c in (
            F.min(F.when(own(i) & (upto(i) > rank(i)), F.col("_mn"))).alias(f"_nlo{i}"),
            F.min(F.when(own(i) & (upto(i) > rank(i)), F.col("_mx"))).alias(f"_nhi{i}"),
            F.coalesce(F.max(F.when(own(i) & (upto(i) <= rank(i)), F.col("_cum"))), F.lit(0)).alias(f"_below{i}"),
            F.min(F.when(own(i) & (upto(i) > rank(i)), F.col("_cum"))).alias(f"_through{i}"))])
        moved = lambda i: F.col(f"_nlo{i}").isNotNull()
        left = lambda i: F.col(f"_through{i}") - F.col(f"_below{i}")
        state, few = settle(state.join(narrowed, keys, "left").select(*keys, "n", *[c for i in idx for c in (
            F.coalesce(f"_nlo{i}", f"_lo{i}").alias(f"_lo{i}"), F.coalesce(f"_nhi{i}", f"_hi{i}").alias(f"_hi{i}"),
            F.when(moved(i), F.col(f"_lt{i}") + F.col(f"_below{i}")).otherwise(F.col(f"_lt{i}")).alias(f"_lt{i}"),
            F.when(moved(i), left(i)).otherwise(F.col(f"_in{i}")).alias(f"_in{i}"),
            # Bins that did not even halve the rows: change the scale.
            F.when(moved(i) & (left(i) * 2 > F.col(f"_in{i}")), ~F.col(f"_log{i}")).otherwise(F.lit(False)).alias(f"_log{i}"))]))
        if not state.where(_any([wide(i) for i in idx])).take(1):
            break
    else:
        raise RuntimeError("quantile bounds did not narrow")

    def quantile(j: int, value) -> Column:
        a, b = value(2 * j), value(2 * j + 1)
        return a + (b - a) * (position(2 * j) - F.floor(position(2 * j)))

    if not state.where(_any([~settled(i) for i in idx])).take(1):
        return state.select(*keys, "n", F.array(*[quantile(j, lambda i: F.col(f"_lo{i}")) for j in range(len(probs))]).alias("q"))

    # Put the values left between the bounds in order and read off the wanted ranks.
    hits = F.array(*[
        F.when(~settled(i) & F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}")), F.struct(
            F.lit(i).alias("_q"), rank(i).alias("_k"), F.col(f"_lt{i}").alias("_lt")))
        for i in idx])
    values = attach(state, few).select(*keys, "_v", F.explode(hits).alias("_h")).where("_h IS NOT NULL").groupBy(
        *keys, "_v", "_h._q", "_h._k", "_h._lt").agg(F.count("*").alias("_m"))
    w = Window.partitionBy(*keys, "_q").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    reached = values.withColumn("_cum", F.col("_lt") + F.sum("_m").over(w)).where(F.col("_cum") > F.col("_k"))
    picked = reached.groupBy(*keys).agg(*[F.min(F.when(F.col("_q") == i, F.col("_v"))).alias(f"_a{i}") for i in idx])
    found = lambda i: F.when(settled(i), F.col(f"_lo{i}")).otherwise(F.col(f"_a{i}"))
    return state.join(picked, keys, "left").select(
        *keys, "n", F.array(*[quantile(j, found) for j in range(len(probs))]).alias("q"))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def quantile_values(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, list[float]]:
    """Quantiles of whole columns as plain numbers (one small row per column); empty columns are absent."""
    return {r["column"]: list(r["q"]) for r in exact_quantiles(df, cols, probs, **kw).collect()}
