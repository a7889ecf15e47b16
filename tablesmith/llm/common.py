"""Helpers that the corpus operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesmith.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; -1 for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n)).cast("int"), F.lit(-1))


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop a query's shuffle files when the query has ended; results live on as written tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def text_key(text: Column) -> Column:
    """Tells rows that share an id but not the text apart; rows alike in both have one result."""
    return F.xxhash64(text)


def packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The caller's row as one struct ``row``, so that none of its names meets ``more`` or a name used further on."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(n) for n, c in more.items()])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The caller's columns back in order, those in ``changed`` with new values."""
    return rows.select(*[(changed[c] if c in changed else F.col("row").getField(c)).alias(c) for c in columns])


def without_rows(docs: DataFrame, id_col: str, text_col: str, gone: DataFrame, again: DataFrame) -> DataFrame:
    """``docs`` without the rows in ``gone`` and with one of each of those in ``again``, both (doc_id, h: text key)."""

    def among(rows: DataFrame, some: DataFrame, how: str) -> DataFrame:
        some = some.select(F.col("doc_id").alias("some_id"), F.col("h").alias("some_h"))
        return rows.join(some, F.col("id").eqNullSafe(F.col("some_id")) & F.col("h").eqNullSafe(F.col("some_h")), how)

    kept = among(packed(docs, id=F.col(id_col), h=text_key(F.coalesce(F.col(text_col), F.lit("")))), gone, "left_anti")
    if not again.isEmpty():
        kept = among(kept, again, "left_anti").unionByName(among(kept, again, "left_semi").dropDuplicates(["id", "h"]))
    return unpacked(kept, docs.columns)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of ``edges``: every node of an edge with ``root``, the same for a whole component.

    Each round every node hooks onto the smallest of its neighbours and itself, and the graph shrinks to the nodes
    that were hooked onto. The order is the node's value in the first round and a fresh hash afterwards, so that also
    long chains shrink by a constant share per round. Minima are combined before each shuffle and the joins on a hub
    are ordinary shuffled joins that adaptive execution splits, so a hub needs no single task.
    """
    edges = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    parents: list[DataFrame] = []
    while not edges.isEmpty():
        seed = len(parents)
        order = (lambda c: c) if seed == 0 else (lambda c, seed=seed: F.xxhash64(c, F.lit(seed)))
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy("a").agg(F.min(F.struct(order(F.col("b")).alias("o"), F.col("b").alias("n"))).alias("m"))
        mine = F.struct(order(F.col("a")).alias("o"), F.col("a").alias("n"))
        parent = written(best.select(F.col("a").alias("node"), F.least(mine, F.col("m"))["n"].alias("up")), "parents")
        left = parent.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        right = parent.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        edges = written(
            edges.join(left, "a").join(right, "b").where("ua <> ub")
            .select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        parents.append(parent)
    if not parents:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root"))

    def climb(labels: DataFrame, parent: DataFrame) -> DataFrame:
        up = parent.select(F.col("node").alias("root"), "up")
        return labels.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root"))

    return reduce(climb, parents[1:], parents[0].select("node", F.col("up").alias("root")))
