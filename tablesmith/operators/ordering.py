"""Positions and running totals over a total order, without a one-task window.

Small inputs (a checked size) use an ordinary window. Larger ones are range-partitioned on the
whole sort key, fixed in the shared folder, scanned range by range, and completed with the totals
of the ranges before. A group that spans several ranges is carried over, so one hot group is split.
The sort key must be unique (end it with a key column).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablesmith.session import stable

SMALL = 200_000            # rows that one window task may order
ROWS_PER_RANGE = 2_000_000


def _cols(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def is_small(df: DataFrame, limit: int) -> bool:
    """A full count: parallel, and for plain Parquet tables answered from the file footers."""
    return df.count() <= limit


def _ranges(df: DataFrame, order, by) -> DataFrame:
    spark = df.sparkSession
    n = df.count()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // ROWS_PER_RANGE + 1)
    cut = df.repartitionByRange(ranges, *[F.col(b) for b in by], *_cols(order))
    # The checkpoint keeps the row-to-range assignment fixed for the passes that follow.
    return stable(cut.withColumn("_range", F.spark_partition_id()))


def running(
    df: DataFrame,
    order: Sequence[str | Column],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    small: int = SMALL,
) -> DataFrame:
    """Add inclusive running sums: ``sums`` maps a new column name to the summed expression."""
    by = list(by)
    if is_small(df, small):
        w = Window.partitionBy(*by).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({name: F.sum(e).over(w) for name, e in sums.items()})

    fixed = _ranges(df, order, by)
    inner = Window.partitionBy("_range", *by).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        fixed.groupBy("_range", *by).agg(*[F.sum(e).alias(f"_t_{name}") for name, e in sums.items()],
                                         F.lit(1).alias("_one"))
        .withColumns({f"_off_{name}": F.sum(f"_t_{name}").over(before) for name in sums})
        .withColumn("_prior", F.count("_one").over(before))
        .where("_prior > 0")
        .select(F.col("_range").alias("_r"), *[F.col(b).alias(f"_b{i}") for i, b in enumerate(by)],
                *[f"_off_{name}" for name in sums])
    )
    match = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        match = match & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    # At most one group per range continues from earlier ranges: carry has no more rows than ranges.
    joined = fixed.join(F.broadcast(carry), match, "left")

    def total(name: str, e: Column) -> Column:
        # NULL until the first value, as in a plain window.
        off, own = F.col(f"_off_{name}"), F.sum(e).over(inner)
        return F.when(off.isNotNull() | own.isNotNull(), F.coalesce(off, F.lit(0)) + F.coalesce(own, F.lit(0))).alias(name)

    return joined.select(*df.columns, *[total(name, e) for name, e in sums.items()])


def with_position(df: DataFrame, order, by: Sequence[str] = (), name: str = "pos", small: int = SMALL) -> DataFrame:
    """Add the 0-based position of each row within its group."""
    out = running(df, order, {name: F.lit(1).cast("long")}, by, small)
    return out.withColumn(name, F.col(name) - 1)


def trailing(
    df: DataFrame,
    order,
    n: int,
    aggs: dict[str, tuple],
    by: Sequence[str] = (),
    small: int = SMALL,
    block: int = 1_000_000,
) -> DataFrame:
    """Aggregates over the last ``n`` rows; ``aggs`` maps a name to (aggregate function, column).

    Large inputs are cut into blocks of positions; the last ``n - 1`` rows of each block are
    repeated in front of the next one, so every frame is complete inside its block.
    """
    by = list(by)
    if is_small(df, small):
        w = Window.partitionBy(*by).orderBy(*_cols(order)).rowsBetween(-(n - 1), 0)
        return df.withColumns({k: fn(c).over(w) for k, (fn, c) in aggs.items()})
    block = max(block, n)
    placed = with_position(df, order, by, "_pos", small)
    own = F.floor(F.col("_pos") / block)
    copies = F.array(
        F.struct(own.alias("b"), F.lit(False).alias("halo")),
        F.when(F.pmod(F.col("_pos"), F.lit(block)) >= block - (n - 1),
               F.struct((own + 1).alias("b"), F.lit(True).alias("halo"))))
    spread = placed.select(*df.columns, "_pos", F.explode(copies).alias("_at")).where("_at IS NOT NULL")
    w = Window.partitionBy(*by, F.col("_at.b")).orderBy("_pos").rowsBetween(-(n - 1), 0)
    done = spread.withColumns({k: fn(c).over(w) for k, (fn, c) in aggs.items()})
    return done.where(~F.col("_at.halo")).select(*df.columns, *aggs)
