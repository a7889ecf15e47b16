"""Pages, previews, repeatable samples and feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def page(df: DataFrame, order: str, key: str, page: int = 1, per_page: int = 20, after: tuple | None = None) -> DataFrame:
    """One page, newest first, with total, page count and whether there is a next page.

    ``after=(order value, key)`` continues from the last row seen: a deep page then costs the same as
    the first one. ``page`` is for shallow offsets.
    """
    total = df.count()
    pages = -(-total // per_page)
    newest = [F.desc(order), F.desc(key)]
    if after is not None:
        o, k = F.lit(after[0]), F.lit(after[1])
        rows = df.where((F.col(order) < o) | ((F.col(order) == o) & (F.col(key) < k))).orderBy(*newest).limit(per_page)
        return rows.withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(pages).cast("long")})
    rows = df.orderBy(*newest).offset((page - 1) * per_page).limit(per_page)
    return rows.withColumns({
        "total": F.lit(total).cast("long"), "pages": F.lit(pages).cast("long"), "has_next": F.lit(page < pages)})


def preview(df: DataFrame, n: int, key: str) -> DataFrame:
    total = df.count()
    return df.orderBy(key).limit(n).withColumns({
        "total_rows": F.lit(total).cast("long"), "truncated": F.lit(total > n)})


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, chosen by the hash of seed and key: repeatable on any partitioning."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def scatter_data(df: DataFrame, x: str, y: str, key: str, color: str | None = None, size: str | None = None, n: int = 2000) -> DataFrame:
    cols = dict.fromkeys([key, x, y, *[c for c in (color, size) if c]])
    return sample_n(df.select(*cols), n, key)


def rank_importance(coefs: DataFrame, name: str = "feature", value: str = "coefficient") -> DataFrame:
    return coefs.withColumn("abs_value", F.abs(value)).orderBy(F.desc("abs_value"), name)


def union_feeds(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def recent_activity(feeds: Sequence[DataFrame], n: int = 5) -> DataFrame:
    """Newest ``n`` of several feeds with ``kind, id, title, created, status``."""
    merged = feeds[0]
    for f in feeds[1:]:
        merged = union_feeds(merged, f)
    return merged.where(F.col("id").isNotNull() & F.col("created").isNotNull()).orderBy(
        F.desc("created"), "kind", "id").limit(n)


def union_same_header(frames: Sequence[DataFrame]) -> tuple[DataFrame, list[int]]:
    """Append the tables whose header equals the first one's; the positions of the others are returned."""
    out, skipped = frames[0], []
    for i, f in enumerate(frames[1:], start=1):
        if f.columns == frames[0].columns:
            out = out.unionByName(f)
        else:
            skipped.append(i)
    return out, skipped


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()
