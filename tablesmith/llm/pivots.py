"""Near copies of vectors by a pivot-permutation index.

A vector is described by its ``DEPTH`` nearest reference points in order. The points are fixed random directions, not
vectors of the table: how often two vectors share some depends on their own angle only, so a crowd of near vectors does
not crowd its neighbourhood with points. There are far more points than a vector names, and more where there are more
vectors. Inverted lists (group, pivot) hold the vectors described by a pivot; within a list the number of shared pivots
selects pairs first, and the exact cosine in double precision is worked out for those alone. A pair counts in the list of its smallest shared pivot only, so no pair is told twice. Copies travel as one
class with a count. Lists are read a share at a time, so that no more than about one copy of the vectors is on the way at
once. A list much longer than the others is dealt by pairs of blocks; each task sorts its list by second shared pivots, or
compares all its pairs by matrix products where that is less work, and hands back counts and one link per vector to its
cluster, never pairs. Vectors of single precision stay so on the way; tasks draw the reference points from their seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from tablesmith.llm.common import components, written

THRESHOLD = 0.93
#: One pivot for ``VECTORS_PER_PIVOT`` vectors of a length, within these bounds, and fewer where ``RECALL`` asks for it.
VECTORS_PER_PIVOT, MIN_PIVOTS, MAX_PIVOTS = 16, 1024, 65_536
#: Above this share of pairs that share enough pivots, all cosines of a tile at once cost less than one by one.
DENSE = 0.1
DEPTH, SHARED = 10, 2
#: Least share of pairs just at the threshold that must share enough pivots.
RECALL = 0.999
#: A list is dealt by blocks if it is longer than this and than twice the mean list, or than ``LONGEST``.
BLOCK, LONGEST = 2048, 32_768
#: Lists are read in as many shares as keep one share's vectors within so many bytes; ``DEPTH`` shares at most.
SHARE_BYTES = 1 << 28
_TILE = 512
#: Similarities held at once; sizes up to which sub-lists are walked pair by pair; pairs checked one by one at once.
_HELD, _SMALL, _PAIRS = 1 << 21, 24, 1 << 18
#: Checking a pair by itself costs as much as so many by matrix products.
_ALONE = 50


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Equally long values of a binary column as the rows of a matrix."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind).reshape(len(column), -1)


def _clean(kind: str):
    """Bytes of the vectors that can link: not null or zero, all components finite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            # a null component becomes NaN here
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
            fine, some = np.zeros(len(batch), bool), np.flatnonzero(lengths)
            if len(some):
                top = np.maximum.reduceat(np.abs(x), ends[some])
                fine[some] = np.isfinite(top) & (top > 0)
                with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                    square = np.add.reduceat(np.square(x, dtype=np.float64), ends[some])
                # Lengths that double precision cannot square are measured from the largest component.
                far = fine[some] & ~((square > 1e-290) & (square < 1e290))
                if far.any():
                    x = x / np.repeat(np.where(far, top, 1), lengths[some])
            bits = np.packbits(fine, bitorder="little")
            v = pa.Array.from_buffers(
                pa.binary(), len(batch), [pa.py_buffer(bits), pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.record_batch([batch.column(0), batch.column(1), v], names=["id", "label", "v"])

    return run


def _largest(similar: np.ndarray, depth: int) -> np.ndarray:
    """Columns of the ``depth`` largest values of each row, largest first."""
    rows, wide = similar.shape
    groups = wide // 8
    if groups < 2 * depth:
        some = np.argpartition(-similar, depth - 1, axis=1)[:, :depth]
        return np.take_along_axis(some, np.argsort(-np.take_along_axis(similar, some, axis=1), axis=1, kind="stable"), axis=1)
    # The largest of some groups of columns bound the value wanted from below; few columns reach it.
    tops = similar[:, :8 * groups].reshape(rows, 8, groups).max(axis=1)
    least = np.partition(tops, groups - depth, axis=1)[:, groups - depth]
    i, j = np.divmod(np.flatnonzero(similar >= least[:, None]), wide)
    order = np.lexsort((-similar[i, j], i))
    return j[order][np.searchsorted(i, np.arange(rows))[:, None] + np.arange(depth)]


def _nearest(x: np.ndarray, pivots: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the nearest pivots of each unit vector, nearest first, and their cosines."""
    depth = min(depth, len(pivots))
    at, cosines, step = np.empty((len(x), depth), np.int64), np.empty((len(x), depth)), max(1, _HELD // len(pivots))
    for s in range(0, len(x), step):
        similar = x[s:s + step] @ pivots.T
        at[s:s + step] = some = _largest(similar, depth)
        cosines[s:s + step] = np.take_along_axis(similar, some, axis=1)
    return at, cosines


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions of the ``depth`` nearest pivots of each unit vector, nearest first."""
    return _nearest(x, pivots, depth)[0]


@lru_cache(2)
def drawn(dim: int, count: int) -> np.ndarray:
    """The first ``count`` random directions of a length, the same wherever they are drawn."""
    return unit(np.random.default_rng(dim).normal(size=(count, dim)))


def fitting(dim: int, wanted: int, threshold: float = THRESHOLD, shared: int = SHARED) -> int:
    """How many of ``wanted`` directions to take: halved until random pairs just at the threshold share enough of them.

    With ``DEPTH`` directions or fewer all vectors share all, so no length is too short. Directions are drawn and compared
    some at a time, from the fewest up, with each vector's nearest so far.
    """
    rng = np.random.default_rng([dim, 1])
    x, y = unit(rng.normal(size=(4000, dim))), rng.normal(size=(4000, dim))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * unit(y) if dim > 1 else x
    sizes = [wanted]
    while sizes[-1] > DEPTH:
        sizes.append(max(DEPTH, sizes[-1] // 2))
    pairs = np.concatenate([x, y])
    rng, step, fit, done = np.random.default_rng(dim), max(1, _HELD // dim), sizes[-1], 0
    near, value = np.empty((len(pairs), 0), np.int64), np.empty((len(pairs), 0))
    for size in reversed(sizes):
        while done < size:
            some = unit(rng.normal(size=(min(step, size - done), dim)))
            at, cosines = _nearest(pairs, some, DEPTH)
            near, value = np.concatenate([near, at + done], axis=1), np.concatenate([value, cosines], axis=1)
            best = np.argsort(-value, axis=1, kind="stable")[:, :DEPTH]
            near, value = np.take_along_axis(near, best, axis=1), np.take_along_axis(value, best, axis=1)
            done += len(some)
        if ((near[:4000, :, None] == near[4000:, None, :]).sum(axis=(1, 2)) >= shared).mean() >= RECALL:
            fit = size
    return fit


def directions(dim: int, wanted: int, threshold: float = THRESHOLD, shared: int = SHARED) -> np.ndarray:
    """At most ``wanted`` random unit vectors, as many as ``fitting`` says."""
    return drawn(dim, fitting(dim, wanted, threshold, shared))


def _described(counts: dict[int, int], kind: str, shared: int):
    """Rows (label, id, n, v, listed, pivots) with the pivots of each class in order of their numbers, and the lists it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(3)
            dims = pc.binary_length(v).to_numpy(zero_copy_only=False) // np.dtype(kind).itemsize
            listed: list[list[int]] = [[]] * len(dims)
            orders: list[bytes] = [b""] * len(dims)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                same = v if len(at) == len(dims) else v.take(pa.array(at))
                near = np.sort(nearest_pivots(unit(_matrix(same, kind)), drawn(dim, counts[dim])), axis=1).astype(np.uint16)
                # a pair is told in the list of its smallest shared pivot, which is never among the last ``shared - 1`` of either
                for i, o, few in zip(at.tolist(), near, near[:, :max(0, near.shape[1] - (shared - 1))].tolist()):
                    listed[i], orders[i] = few, o.tobytes()
            yield pa.record_batch(
                [*batch.columns, pa.array(listed, pa.list_(pa.int32())), pa.array(orders, pa.binary())], names=["label", "id", "n", "v", "listed", "pivots"])

    return run


def _told_here(orders: np.ndarray, other: np.ndarray, pivot: int, shared: int, second: int | None = None) -> np.ndarray:
    """Which pairs share enough pivots and none below the list's own; with ``second``, which both hold, none below that but the list's own."""
    names, at = np.unique(np.concatenate([orders, other]), return_inverse=True)
    at = at.reshape(-1, orders.shape[1])
    held = np.zeros((len(at), len(names)), np.float32)
    np.put_along_axis(held, at, 1, axis=1)
    a, b = held[:len(orders)], held[len(orders):]
    below = int(np.searchsorted(names, pivot if second is None else second))
    told = a[:, :below] @ b[:, :below].T == (0 if second is None else 1)
    return told if second is not None and shared <= 2 else told & (a @ b.T >= shared)


def _bundles(linked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and columns of each connected part of a table of links; every row and column is walked once."""
    rows_left, cols_left = linked.any(axis=1), linked.any(axis=0)
    while rows_left.any():
        rows, cols = np.zeros_like(rows_left), np.zeros_like(cols_left)
        fresh = np.array([int(rows_left.argmax())])
        while len(fresh):
            rows[fresh] = True
            rows_left[fresh] = False
            reached = np.flatnonzero(linked[fresh].any(axis=0) & cols_left)
            cols[reached] = True
            cols_left[reached] = False
            fresh = np.flatnonzero(linked[:, reached].any(axis=1) & rows_left)
        yield np.flatnonzero(rows), np.flatnonzero(cols)


def block_links(ids: np.ndarray, n: np.ndarray, x: np.ndarray, orders: np.ndarray, left: np.ndarray, right: np.ndarray, pivot: int,
                threshold: float = THRESHOLD, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Links of one pair of blocks: (number of linked vectors, smallest linked cluster member) per row.

    ``left`` and ``right`` are row positions; equal for a block against itself.
    """
    count, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    same = left is right
    for s in range(0, len(left), _TILE):
        rows = left[s:s + _TILE]
        for t in range(s if same else 0, len(right), _TILE):
            cols = right[t:t + _TILE]
            linked = _told_here(orders[rows], orders[cols], pivot, shared)
            if same and s == t:
                linked &= np.triu(np.ones(linked.shape, bool), 1)
            i, j = np.nonzero(linked)
            if len(i) > DENSE * linked.size:
                linked &= x[rows] @ x[cols].T >= threshold
            else:
                linked[i, j] = np.einsum("ij,ij->i", x[rows[i]], x[cols[j]]) >= threshold
            if not linked.any():
                continue
            count[rows] += linked @ n[cols]
            count[cols] += linked.T @ n[rows]
            for i, j in _bundles(linked):
                tops = set()
                for a in np.concatenate([rows[i], cols[j]]).tolist():
                    while up[a] != a:
                        up[a] = up[up[a]]
                        a = up[a]
                    tops.add(int(a))
                up[list(tops)] = min(tops)
    for i in range(len(up)):
        up[i] = up[up[i]]
    return count, ids[up]


def _joined(up: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``up``, which leads from each row to a smaller one of its cluster, after rows ``i`` and ``j`` are linked."""
    while True:
        while (up[up] != up).any():
            up = up[up]
        a, b = up[i], up[j]
        apart = a != b
        if not apart.any():
            return up
        i, j = i[apart], j[apart]
        np.minimum.at(up, np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart]))


def _near_pairs(x: np.ndarray, orders: np.ndarray, names: np.ndarray, edges: np.ndarray, second: np.ndarray | None, least: float, pivot: int,
                shared: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``x`` in one sub-list whose product reaches ``least``; where these are many, only those told there.

    ``edges`` are the sub-lists' ends, ``names`` each row's second pivot. If ``second`` gives the first row of the other block in
    each sub-list, pairs have a row of both blocks.
    """
    sizes = np.diff(edges)
    small = sizes <= _SMALL
    part = np.repeat(np.arange(len(sizes)), sizes)
    here = np.flatnonzero(small[part])
    for k in range(1, int(sizes[small].max(initial=0))):
        here = here[here + k < edges[part[here] + 1]]
        for s in range(0, len(here), _PAIRS):
            i = here[s:s + _PAIRS]
            if second is not None:
                i = i[(i < second[part[i]]) & (i + k >= second[part[i]])]
            hit = np.einsum("ij,ij->i", x[i], x[i + k]) >= least
            yield i[hit], i[hit] + k
    for g in np.flatnonzero(~small).tolist():
        a, b, e = edges[g], edges[g] if second is None else second[g], edges[g + 1]
        end, rows = e if second is None else b, 1 + _HELD // (e - a)
        for s in range(a, end if b < e else a, rows):
            t = s if second is None else b
            near = x[s:min(s + rows, end)] @ x[t:e].T >= least
            if np.count_nonzero(near) > len(near) + near.size // _ALONE:
                near &= _told_here(orders[s:s + len(near)], orders[t:e], pivot, shared, int(names[a]))
            i, j = np.divmod(np.flatnonzero(near), e - t)
            if second is None:
                i, j = i[i < j], j[i < j]
            yield i + s, j + t


def sub_list_links(ids: np.ndarray, n: np.ndarray, x: np.ndarray, orders: np.ndarray, side: np.ndarray | None, pivot: int,
                   threshold: float = THRESHOLD, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray] | None:
    """What ``block_links`` tells, from the pairs that also share a second pivot; None if that is more work than all pairs.

    ``side`` says which rows are of the right block, None if both blocks are the same. A pair is told where its second
    smallest shared pivot is. Products in single precision leave out pairs that are surely below the threshold.
    """
    row, at = np.nonzero(orders > pivot)
    other = orders[row, at].astype(np.int64) * 2 + (0 if side is None else side[row])
    order = np.argsort(other, kind="stable")
    row, other = row[order], other[order]
    names = other // 2
    edges = np.concatenate([[0], np.flatnonzero(np.diff(names)) + 1, [len(names)]])
    sizes = np.diff(edges)
    if (sizes * sizes).sum() > len(ids) * len(ids):
        return None
    second = None if side is None else edges[:-1] + np.add.reduceat(other % 2 == 0, edges[:-1], dtype=np.int64)
    count, up = np.zeros(len(ids), np.int64), np.arange(len(ids))
    least = np.float32(threshold - 2.0**-22 * (x.shape[1] + 8))
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    alone = 0

    def tell():
        nonlocal up
        i, j, q = (np.concatenate(c) for c in zip(*held))
        held.clear()
        for s in range(0, len(i), _PAIRS):
            a, b, own = i[s:s + _PAIRS], j[s:s + _PAIRS], q[s:s + _PAIRS, None]
            both = (orders[a][:, :, None] == orders[b][:, None, :]).any(axis=2)
            below = both & (orders[a] < own)
            told = (both.sum(axis=1) >= shared) & (below.sum(axis=1) == 1) & (below & (orders[a] == pivot)).any(axis=1)
            a, b = a[told], b[told]
            linked = np.einsum("ij,ij->i", unit(x[a]), unit(x[b])) >= threshold
            a, b = a[linked], b[linked]
            np.add.at(count, a, n[b])
            np.add.at(count, b, n[a])
            up = _joined(up, a, b)

    for i, j in _near_pairs(unit(x).astype(np.float32)[row], orders[row], names, edges, second, least, pivot, shared):
        if len(i):
            alone += len(i)
            if alone > max(_PAIRS, len(ids) * len(ids) // _ALONE):
                return None
            held.append((row[i], row[j], names[i]))
            if sum(len(h[0]) for h in held) > _PAIRS:
                tell()
    if held:
        tell()
    return count, ids[up]


def _lists(kind: str, threshold: float, shared: int):
    def done(now: tuple, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(len(h) for h in held) < 2:
            return
        block, ids, n = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (5, 6, 7))
        x, orders = (np.concatenate([_matrix(h.column(c), k) for h in held]) for c, k in ((8, kind), (9, "<u2")))
        _, _, pivot, i, j = now
        found = None
        if shared > 1 and len(ids) > _SMALL:
            found = sub_list_links(ids, n, x, orders, None if i == j else block == j, pivot, threshold, shared)
        if found is None:
            left = np.flatnonzero(block == i)
            found = block_links(ids, n, unit(x), orders, left, left if i == j else np.flatnonzero(block == j), pivot, threshold, shared)
        some = np.flatnonzero(found[0] > 0)
        if len(some):
            yield pa.record_batch([pa.array(ids[some]), pa.array(found[0][some]), pa.array(found[1][some])], names=["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            change = np.zeros(max(0, len(batch) - 1), bool)
            for c in (batch.column(0).dictionary_encode().indices, *batch.columns[1:5]):
                change |= np.diff(c.to_numpy()) != 0
            for s, e in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), len(batch)]):
                if s == e:
                    continue
                key = tuple(batch.column(c)[s].as_py() for c in range(5))
                if key != now:
                    if held:
                        yield from done(now, held)
                    now, held = key, []
                held.append(batch.slice(s, e - s))
        if held:
            yield from done(now, held)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 threshold: float = THRESHOLD, shared: int = SHARED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite components, link with
    nothing; vectors of different length neither. Repeated vectors link with each other. A null id is left out of the
    index: no links, null component, not kept. Pairs that share fewer than ``shared`` of their nearest pivots are
    missed: of pairs just at the threshold about one in a thousand, of nearer ones fewer, however many vectors lie near
    them. An empty table gives none.
    """
    element = vectors.schema[vector_col].dataType
    single = isinstance(element, ArrayType) and isinstance(element.elementType, FloatType)
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))
    clean = written(rows.mapInArrow(_clean(kind), "id bigint, label string, v binary"), "vectors")
    able = clean.where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    key = [F.xxhash64("v").alias("h"), F.unhex(F.md5("v")).alias("m")]
    dims = able.select("label", (F.octet_length("v") / width).cast("int").alias("dim"), *key).distinct().groupBy("dim").count().collect()
    counts = {d: fitting(d, max(MIN_PIVOTS, min(MAX_PIVOTS, n // VECTORS_PER_PIVOT)), threshold, shared) for d, n in dims}
    classes = able.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("label", "id", "n", "v")
    index = written(
        classes.mapInArrow(_described(counts, kind, shared), "label string, id bigint, n bigint, v binary, listed array<int>, pivots binary"), "index")
    place = ["label", "dim", "pivot"]
    spread = index.withColumn("dim", F.octet_length("v"))
    lengths = written(spread.select("label", "dim", F.explode("listed").alias("pivot")).groupBy(*place).count(), "lengths")
    total = lengths.agg(F.sum("count"), F.count("*"), F.sum(F.col("count") * F.col("dim"))).first()
    block = min(LONGEST, max(BLOCK, 2 * (total[0] or 0) // max(1, total[1])))
    # There are at most as many of these as blocks of rows.
    long = lengths.where(F.col("count") > block).select(*place, F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    short_only = long.isEmpty()
    blocks = F.coalesce("blocks", F.lit(1))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("i"), F.greatest(b, F.col("block")).alias("j")))
    shares = min(DEPTH, 1 + (total[2] or 0) // SHARE_BYTES)
    lists, first = [*place, "i", "j"], F.lit(0)
    parts = []
    for share in range(shares):
        dealt = spread.withColumn("pivot", F.explode(F.expr(f"filter(listed, p -> p % {shares} = {share})")))
        if short_only:
            dealt = dealt.select(*place, first.alias("i"), first.alias("j"), first.alias("block"), "id", "n", "v", "pivots")
        else:
            dealt = (
                dealt.join(F.broadcast(long), place, "left").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
                .select(*place, F.inline(others), "block", "id", "n", "v", "pivots"))
        parts.append(written(
            dealt.repartition(*lists).sortWithinPartitions(*lists).mapInArrow(_lists(kind, threshold, shared), "id bigint, links bigint, root bigint"), "links"))
    told = reduce(DataFrame.unionAll, parts)
    roots = written(components(told, "id", "root"), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    found = roots.join(least, "root").select(F.col("node").alias("id"), "component")
    sums = told.groupBy("id").agg(F.sum("links").alias("links"))
    result = (
        index.select("label", *key, "id", "n").join(sums, "id", "left").join(found, "id", "left")
        .select("label", "h", "m", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component")))
    keyed = clean.select("id", "label", *key, F.isnotnull("v").alias("fine"))
    able = F.col("id").isNotNull() & F.col("fine")
    found = keyed.where(able).join(result, ["label", "h", "m"], "left").select("id", "links", "component").unionByName(
        keyed.where(~able).select("id", F.lit(None).cast("long").alias("links"), F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))
