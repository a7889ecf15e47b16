"""Near copies of texts: five-word shingles, similarity 0.8 or more, one document of each group stays.

Each distinct set of shingles has a SimHash fingerprint. Sets are dealt into shards by shingle: in one order of all shingles,
rare before common, two sets of similarity 0.8 share one of the first fifth of each, so the shards of these hold every such
pair. A BK-tree per shard finds each fingerprint's nearest earlier ones, the exact Jaccard similarity confirms them, and
connected components follow. Fingerprints of texts of similarity 0.8 can lie arbitrarily far apart and a crowd has
more pairs than its nearest, so all pairs of a shard that the trees left in different components are judged
afterwards: by sizes, by the shingle's place in both, by counts of shingles per class, all of which bound the similarity from above,
and then exactly. No pair is missed; a crowd that the trees connect lists no further pairs.

The exact Jaccard similarity is of 32 bits of each shingle's hash. Equal sets travel as one row, so a group of copies is one set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tablesmith.llm.common import components, text_key, without_rows, written
from tablesmith.llm.simhash import BKTree

WORDS, SIMILAR = 5, 0.8
#: What a tree proposes: the nearest earlier fingerprints, so many at most and within so many bits.
RADIUS, PARTNERS = 16, 2
#: Shards with more sets are dealt further by bits of the fingerprint before trees are built.
BUCKET = 1024
#: Sets whose pairs one task judges at once; larger shards are cut into blocks, and each two blocks meet.
BLOCK = 4096
#: The most common shingles, known by count, come last in the order; any order is right, this one keeps shards small.
COMMON = 1 << 19
#: Classes of shingles that are counted for each set.
CLASSES = 128
BROADCAST_SETS = 1_000_000
_STEP = 500
_SHINGLES_AT_ONCE = 1 << 21
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of a text's five-word shingles, ascending; A-Z count as a-z, fewer words are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    size = min(WORDS, len(words))
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(words[i:i + size])) for i in range(len(words) - size + 1)], dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = sum(((part[:, None] & _BITS) != 0).sum(axis=0) for part in np.array_split(hashes, len(hashes) // 4096 + 1))
    return int((_BITS[2 * ones > len(hashes)]).sum(dtype=np.uint64))


def first_fifth(hashes: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of which two sets of similarity 0.8 share one: by rank (0 if not ``common``: hashes ascending, ranks), then by hash."""
    keys, ranks = common
    rank = np.zeros(len(hashes), dtype=np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        rank = np.where(keys[at] == hashes, ranks[at], 0)
    # Four fifths of a set at least are in both.
    return hashes[np.argsort(rank, kind="stable")][:len(hashes) - (4 * len(hashes) + 4) // 5 + 1]


def class_counts(hashes: np.ndarray) -> bytes:
    """Shingles per class, 255 at most: sums of differences never exceed the number of shingles in one of two sets only."""
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=CLASSES), 255).astype(np.uint8).tobytes()


_SETS = "doc_id {}, h bigint, s bigint, n int, fp bigint, first array<bigint>, classes binary, hashes binary"
_SETS_NAMES = [c.split()[0] for c in _SETS.split(", ")]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of few, so that little is held at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, _STEP):
            yield batch.slice(start, _STEP)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that occur in several texts of some that are read together, with their number."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

    for batch in _small(batches):
        for t in batch.column(0).to_pylist():
            held.append(shingles(t))
            size += len(held[-1])
            if size > _SHINGLES_AT_ONCE:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``COMMON`` of the most common shingles at most: hashes ascending, and ranks from 1, the most common last."""
    counts = written(texts.mapInArrow(_repeated, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")), "repeated")
    scale = F.floor(F.log2("n") * 8).cast("int")
    least, room = None, COMMON
    for r in sorted(counts.groupBy(scale.alias("scale")).count().collect(), reverse=True):
        if (room := room - r["count"]) < 0:
            break
        least = r["scale"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    got = counts.where(scale >= least).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    ranks = np.empty(len(h), dtype=np.int64)
    ranks[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], ranks[order]


def _described(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in _small(batches):
            found = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([
                batch.column(0), batch.column(1), pa.array([xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in found], pa.int64()),
                pa.array([len(x) for x in found], pa.int32()), pa.array(np.array([fingerprint(x) for x in found], dtype=np.uint64).view(np.int64)),
                pa.array([first_fifth(x, common).view(np.int64) for x in found], pa.list_(pa.int64())), pa.array([class_counts(x) for x in found], pa.binary()),
                pa.array([np.unique(x.astype(np.uint32)).tobytes() for x in found], pa.binary())], names=_SETS_NAMES)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, s, n, ...) sorted by key and n without those to which no other row of the key is close enough in size."""
    held, follows = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key, n = rows.column(0).to_numpy(), rows.column(2).to_numpy().astype(np.int64)
        same = (key[1:] == key[:-1]) & (5 * n[:-1] >= 4 * n[1:])
        yield rows.slice(0, len(key) - 1).filter(pa.array((np.r_[follows, same] | np.r_[same, False])[:-1]))
        held, follows = rows.slice(len(key) - 1), bool(len(same) and same[-1])
    if held is not None and follows:
        yield held


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each key's rows, of rows sorted by key; keys with one row are left out."""
    held: list[pa.RecordBatch] = []

    def values(column: pa.ChunkedArray) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, CLASSES) if pa.types.is_binary(column.type) else column.to_numpy()

    def closed(rows: list[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        columns = [values(c) for c in pa.Table.from_batches(rows).columns]
        key = columns[0]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]).tolist() if len(key) else []
        for a, b in zip(starts, [*starts[1:], len(key)]):
            if b - a > 1:
                yield [c[a:b] for c in columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or (held and held[-1].column(0)[-1].as_py() != key[-1]):
            yield from closed([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield from closed(held)


def _may(n: np.ndarray, m: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether sets of n and m shingles can be similar if the first they share is the at-th and the to-th of their orders.

    Sets are similar if at least 4/9 of the sum of their sizes is in both.
    """
    return 9 * np.minimum(n - at, m - to) >= 4 * (n + m)


def _proposed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, s, n, pos, fp) rows sorted by key and s to pairs (a, b): each set and, by its shard's BK-tree, the nearest earlier ones."""
    a, b = [], []

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for _, s, n, pos, fp in _buckets(batches):
        tree, of, last = BKTree(), [], {}
        s, n, pos = s.tolist(), n.astype(np.int64), pos.astype(np.int64)
        for i, v in enumerate(fp.view(np.uint64).tolist()):
            if v in last:
                near = [last[v]]
            else:
                near = [last[of[j]] for j in tree.nearest_then_add(v, RADIUS, PARTNERS)]
                of.append(v)
            last[v] = i
            for j in near:
                if _may(n[i], n[j], pos[i], pos[j]):
                    a.append(s[i])
                    b.append(s[j])
        if len(a) >= 100_000:
            yield out()
            a, b = [], []
    yield out()


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, s, n, pos, root, block, classes) rows sorted by key and s to all pairs (a, b) that may be similar and have different roots."""
    for _, s, n, pos, root, block, classes in _buckets(batches):
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        # Where two blocks meet, pairs within a block are left to the block alone.
        meet = bool((block != block[0]).any())
        for start in range(0, len(s), 256):
            mine = slice(start, min(start + 256, len(s)))
            ok = _may(n[mine, None], n[None, :mine.stop], pos[mine, None], pos[None, :mine.stop]) & (root[mine, None] != root[None, :mine.stop])
            ok &= np.arange(mine.stop)[None, :] < np.arange(mine.start, mine.stop)[:, None]
            if meet:
                ok &= block[mine, None] != block[None, :mine.stop]
            rows, columns = np.nonzero(ok)
            for x, y in zip(np.array_split(rows + start, len(rows) // 32768 + 1), np.array_split(columns, len(rows) // 32768 + 1)):
                near = 9 * np.abs(classes[x].astype(np.int16) - classes[y]).sum(axis=1, dtype=np.int64) <= n[x] + n[y]
                if near.any():
                    yield pa.record_batch([pa.array(s[x[near]]), pa.array(s[y[near]])], names=["a", "b"])


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _small(batches):
        good = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            p, q = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(both >= SIMILAR * (len(p) + len(q) - both))
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose exact similarity is high enough."""
    used = written(pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct(), "used")
    # Eight bytes a row; above the bound the join is a shuffle.
    used = F.broadcast(used) if used.count() <= BROADCAST_SETS else used
    some = written(sets.select("s", "hashes").join(used, "s", "left_semi").dropDuplicates(["s"]), "compared")
    both = pairs.join(some.toDF("a", "x"), "a").join(some.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(_confirmed, "a bigint, b bigint"), "similar")


def _by_trees(shards: DataFrame, parts: int) -> DataFrame:
    """Pairs (a, b) that the shards' BK-trees propose."""
    bits = F.least(F.ceil(F.log2(F.col("count") / BUCKET)) + 2, F.lit(16)).cast("int")
    full = shards.groupBy("key").count().where(F.col("count") > BUCKET).select("key", bits.alias("bits"))
    # Which bits of the fingerprint deal a large shard follows from its key, so other shards deal its sets differently.
    dealt = F.when(F.col("bits").isNotNull(), F.expr("shiftrightunsigned(fp, cast(pmod(key, 48) as int)) & (shiftleft(1, bits) - 1)"))
    keyed = shards.join(full, "key", "left").select(F.xxhash64("key", dealt).alias("key"), "s", "n", "pos", "fp")
    return keyed.repartition(parts, "key").sortWithinPartitions("key", "s").mapInArrow(_proposed, "a bigint, b bigint").distinct()


def _by_pairs(shards: DataFrame, sets: DataFrame, roots: DataFrame, parts: int) -> DataFrame:
    """All pairs (a, b) of a shard that may be similar and have different ``roots``."""
    named = shards.join(roots.withColumnRenamed("node", "s"), "s", "left").select("key", "s", "n", "pos", F.coalesce("root", "s").alias("root"))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")).where("low <> high")
    blocks = mixed.select("key", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    rows = written(named.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")), "apart")
    classes = sets.select("s", "classes").join(rows.select("s").distinct(), "s", "left_semi").dropDuplicates(["s"])
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.join(classes, "s").select(
        F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "s", "n", "pos", "root", "block", "classes")
    return cells.repartition(parts, "key").sortWithinPartitions("key", "s").mapInArrow(_apart, "a bigint, b bigint").distinct()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, root) per row of ``docs``: ``h`` is the text key, rows of one group share ``root``.

    Null and empty texts have no shingles and are alike. Rows are judged by their texts, so null and repeated ids change
    nothing; long texts are read whole, further columns are left out. An empty table gives none.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[id_col].dataType.simpleString()
    common = spark.sparkContext.broadcast(common_shingles(docs.select(F.col(text_col).alias("text"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    sets = written(rows.mapInArrow(_described(common), _SETS.format(kind)), "shingles")
    one = sets.select("s", "n", "fp", "first").dropDuplicates(["s"])
    cells = one.select(F.posexplode("first").alias("pos", "key"), "s", "n", "fp").select("key", "s", "n", "pos", "fp")
    shards = written(
        cells.repartition(parts, "key").sortWithinPartitions("key", "n").mapInArrow(_shared, "key bigint, s bigint, n int, pos int, fp bigint"), "shards")
    near = written(_by_trees(shards, parts), "proposed")
    links = _links(sets, near)
    roots = written(components(links), "roots")
    rest = written(_by_pairs(shards, sets, roots, parts).join(near, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = written(components(links.union(_links(sets, rest))), "roots")
    return sets.select("doc_id", "h", "s").join(roots.withColumnRenamed("node", "s"), "s", "left").select("doc_id", "h", F.coalesce("root", "s").alias("root"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group: the smallest id, null ids last, then the smallest text key; of rows alike in both, one.

    See ``similar`` for the cases. The columns stay as they are, whatever their names.
    """
    grouped = written(similar(docs, id_col, text_col), "groups")
    row = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "h")
    least = grouped.groupBy("root").agg(F.min(row).alias("first"))
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.h") == F.col("h"))
    near = written(grouped.join(least, "root").select("doc_id", "h", stays.alias("stays")), "near")
    gone = near.where(~F.col("stays")).select("doc_id", "h").distinct()
    again = near.where("stays").groupBy("doc_id", "h").count().where("count > 1").select("doc_id", "h")
    return without_rows(docs, id_col, text_col, gone, again)
