"""Near copies by SimHash: fingerprints, shards of fingerprints that agree in enough bits, a BK-tree per shard.

Every pair of fingerprints within radius 3 agrees in at least three of six bit blocks, so each of the 20 choices of
three blocks deals the distinct fingerprints into shards that together hold every such pair. A shard above
``SHARD_ROWS`` is dealt once more by three of six blocks of its free bits; what is left varies in at most 18 bits, which
bounds a shard whatever the data. The trees are built where their shard is and not broadcast, since they grow with the
corpus. A tree hands back links to the smallest fingerprint of each cluster in the shard, which keeps every connection
with a number of rows linear in the shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tablesmith.llm.common import components, lower_ascii, text_key, without_rows, written

BITS = 64
#: Shards with more fingerprints are dealt a second time.
SHARD_ROWS = 2048
_CHUNK = 1 << 15


def simhash(text: bytes | None, words: int = 3) -> int:
    """The fingerprint of one text as a signed 64-bit number; no words: 0."""
    parts = (text or b"").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(b" ".join(parts), 42)]
    else:
        hashes = [digest(b" ".join(s), 42) for s in zip(*(parts[i:] for i in range(words)))]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(h), _CHUNK):
        ones += np.unpackbits(h[i:i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text, words: int = 3):
    """Column of fingerprints of a text column."""

    @arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t, words) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    return of(text)


class BKTree:
    """Numbers by Hamming distance: each child hangs at its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near_then_add(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius; then the value joins the tree."""
        found, stack = [], [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            for distance, child in children[at].items():
                if d - radius <= distance <= d + radius:
                    stack.append(child)
        self._add(value)
        return found

    def nearest_then_add(self, value: int, radius: int, most: int) -> list[int]:
        """Positions of the nearest values within the radius, ``most`` of them at most; then the value joins the tree."""
        found: list[tuple[int, int]] = []
        stack = [(0, 0)] if self.values else []
        values, children = self.values, self.children
        while stack:
            least, at = stack.pop()
            if least > radius:
                continue
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found = sorted([*found, (d, at)])[:most]
                if len(found) == most:
                    radius = found[-1][0] - 1
            stack += [(abs(distance - d), child) for distance, child in children[at].items() if abs(distance - d) <= radius]
        self._add(value)
        return [at for _, at in found]

    def _add(self, value: int) -> None:
        values, children = self.values, self.children
        at, new = 0, len(values)
        while values:
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = new
                break
            at = children[at][d]
        values.append(value)
        children.append({})


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, smallest value of its cluster) for the clusters that links within the radius make of distinct values."""
    if len(values) < 2:
        return []
    tree, up = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    mask = (1 << BITS) - 1
    for i, v in enumerate(values):
        for j in tree.near_then_add(v & mask, radius):
            x, y = top(i), top(j)
            if x != y:
                up[max(x, y)] = min(x, y)
    return [(values[i], values[top(i)]) for i in range(len(values)) if top(i) != i]


def _blocks(free: list[int], n: int) -> list[int]:
    """Masks of ``n`` runs of the given bit positions."""
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, n)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _tables(free: list[int], radius: int) -> list[int]:
    """Masks such that two numbers within the radius agree, over the free bits, on at least one of them."""
    n = 2 * radius
    return [sum(c) for c in combinations(_blocks(free, n), n - radius)]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        key, held = None, []

        def out(rows):
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

        for batch in batches:
            t, k, v = (batch.column(i).to_numpy() for i in range(3))
            if not len(v):
                continue
            starts = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (k[1:] != k[:-1])])
            ends = np.r_[starts[1:], len(v)]
            rows = []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if (t[s], k[s]) != key:
                    rows += shard_links(held, radius)
                    key, held = (t[s], k[s]), []
                held += v[s:e].tolist()
            yield out(rows)
        yield out(shard_links(held, radius))

    return run


def links(prints: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints in column ``fp`` as all links within the radius do."""
    tables = _tables(list(range(BITS)), radius)
    shards = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(tables)])
    keyed = prints.select("fp", F.inline(shards))
    large = keyed.groupBy("t", "k").count().where(F.col("count") > SHARD_ROWS).select("t", "k", F.lit(True).alias("large"))
    deeper = F.lit(None).cast("array<struct<t:int,k:bigint>>")
    for i, m in enumerate(tables):
        free = [b for b in range(BITS) if not m >> b & 1]
        again = F.array(*[
            F.struct(F.lit(len(tables) * (i + 1) + j).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m | n))).alias("k"))
            for j, n in enumerate(_tables(free, radius))])
        deeper = F.when(F.col("t") == i, again).otherwise(deeper)
    one = F.array(F.struct(F.col("t"), F.col("k")))
    split = (
        keyed.join(large, ["t", "k"], "left")
        .select("fp", F.explode(F.when(F.col("large"), deeper).otherwise(one)).alias("s"))
        .select(F.col("s.t").alias("t"), F.col("s.k").alias("k"), "fp"))
    return split.repartition("t", "k").sortWithinPartitions("t", "k", "fp").mapInArrow(_links(radius), "a bigint, b bigint").distinct()


def _rooted(firsts: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root) of distinct fingerprints with their ``first``."""
    roots = written(components(links(firsts.select("fp"), radius)), "roots")
    return firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint as a long, component_id): component_id is the smallest id reachable over links.

    Null and empty texts have fingerprint 0 and link like any other. A null id never is a component's id; a component
    that has no other id gets null. Repeated rows give one result row each. An empty table gives none.
    """
    prints = written(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "prints")
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    named = _rooted(firsts, radius)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.col("fp").alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id, null ids last, then the smallest text hash.

    A row is known by its id and text, so rows that share an id but not the text, or have no id, are judged one by one.
    Of rows alike in both, one stays.
    """
    key = text_key(F.coalesce(F.col(text_col), F.lit("")))
    prints = written(docs.select(F.col(id_col).alias("doc_id"), key.alias("h"), fingerprint(F.col(text_col), words).alias("fp")), "prints")
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")
    named = _rooted(prints.groupBy("fp").agg(F.min(row).alias("first")), radius)
    least = named.groupBy("root").agg(F.min("first").alias("stays"))
    by_print = named.join(least, "root").select("fp", "stays")
    stays = F.col("stays.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stays.h") == F.col("h"))
    near = written(prints.join(by_print, "fp").select("doc_id", "h", stays.alias("stays")), "near")
    gone = near.where(~F.col("stays")).select("doc_id", "h").distinct()
    again = near.where("stays").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")

    return without_rows(docs, id_col, text_col, gone, again)
