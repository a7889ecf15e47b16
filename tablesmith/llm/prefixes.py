"""The prefix trie of conversations, built as double arrays over ranges of sorted conversations.

1. Rebuild. A turn becomes a 128-bit key of its role and text and the text's length. Each conversation is one row: the first
   turns of its group's head, then its own.
2. Merge copies. Equal conversations become one row with their number and smallest id; the list of their ids is hashed
   block by block, so a conversation that a third of all rows repeat is no single group.
3. Shard. The distinct conversations are sorted turn by turn and cut into ranges. A range is a shard whatever prefixes its
   conversations share, so a common first turn is spread like any other.
4. Trie. A shard numbers its turns densely and packs a double array: the child of node s by turn t lies at BASE[s] + t and
   CHECK says whose child it is. Conversations walk through the arrays and leave their numbers at the nodes.
5. Merge shared nodes. Only nodes on the paths of a shard's first and last conversation can lie in other shards too. Each
   shard knows its neighbours' nearest conversations, so it counts such a node as its own only where the node starts; all
   parts then simply add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tablesmith.llm.common import written

#: Conversations of a group share the head of the first one; at most HEAD - 1 turns are taken from it.
GROUP, HEAD = 100, 6
#: Turns that a shard holds on average, and ids in one block of a hashed list.
SHARD_TURNS, BLOCK = 1 << 19, 4096
_NONE = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """BASE and CHECK over labels 0, 1, ...; slot 0 is the root."""

    def __init__(self) -> None:
        self.base = np.zeros(1024, dtype=np.int64)
        self.check = np.full(1024, -1, dtype=np.int64)
        self.check[0] = 0
        self.free = self.taken = self.end = 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.r_[self.base, np.zeros(more, dtype=np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, dtype=np.int64)]

    def _first_free(self) -> int:
        """The first free slot; all before it are taken."""
        while True:
            ahead = np.flatnonzero(self.check[self.free:self.free + 4096] < 0)
            if len(ahead):
                self.free += int(ahead[0])
                return self.free
            self.free = min(self.free + 4096, len(self.check))
            self._grow(self.free + 4096)

    def _fit(self, offset: np.ndarray) -> int:
        """A free slot from which all slots at ``offset`` are free: among the first free ones, then anywhere, then at the end."""
        start = self._first_free()
        self._grow(self.end + int(offset[-1]) + 2)
        for low, high in ((start, start + 512), (start, self.end)):
            spots = low + np.flatnonzero(self.check[low:high] < 0)
            spots = spots[::max(1, len(spots) // 256)]
            good = spots[(self.check[spots] < 0) & (spots + offset[-1] < len(self.check))]
            for o in offset[1:]:
                good = good[self.check[good + o] < 0]
                if not len(good):
                    break
            if len(good):
                return int(good[0])
        return max(self.end, start)

    def add(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Children of slots without children so far; rows sorted by parent, labels distinct and ascending within one."""
        if not len(parents):
            return
        first = np.flatnonzero(np.r_[True, parents[1:] != parents[:-1]])
        count = np.diff(np.r_[first, len(parents)])
        for s, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            mine = labels[s:s + n]
            offset = mine - mine[0]
            spot = self._fit(offset)
            self.base[parents[s]] = spot - mine[0]
            self.check[spot + offset] = parents[s]
            self.taken += n
            self.end = max(self.end, spot + int(offset[-1]) + 1)
        single = first[count == 1]
        if len(single):
            start = self._first_free()
            self._grow(self.taken + len(single))  # at least so many slots are free
            spots = start + np.flatnonzero(self.check[start:] < 0)[:len(single)]
            self.base[parents[single]] = spots - labels[single]
            self.check[spots] = parents[single]
            self.taken += len(single)
            self.end = max(self.end, int(spots[-1]) + 1)

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The child of each slot by each label, -1 where there is none."""
        at = self.base[slots] + labels
        inside = (at > 0) & (at < len(self.check))
        return np.where(inside & (self.check[np.where(inside, at, 0)] == slots), at, -1)


def _common(a: list[bytes] | None, b: list[bytes] | None) -> int:
    """Length of the common prefix, -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def shard_nodes(rows: list[tuple], before: list[bytes] | None, after: list[bytes] | None) -> dict[str, np.ndarray | list]:
    """The trie nodes of a shard.

    ``rows``: (smallest id, number, keys, lengths, hashed ids), distinct keys in ascending order; ``before`` and
    ``after``: the keys of the nearest conversations of the neighbours.
    """
    rep, number = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
    lengths = np.array([len(r[2]) for r in rows], dtype=np.int64)
    deepest = int(lengths.max())
    ids: dict[bytes, int] = {}
    trie, slot = DoubleArray(), np.zeros(len(rows), dtype=np.int64)
    on_first, on_last = _common(rows[0][2], before), _common(rows[-1][2], after)
    levels = []
    for depth in range(deepest + 1):
        active = np.flatnonzero(lengths >= depth)
        chars = np.zeros(len(active), dtype=np.int64)
        if depth:
            # Turns get their numbers as they come up, so the children of a node mostly have numbers in a row.
            labels = np.array([ids.setdefault(rows[i][2][depth - 1], len(ids)) for i in active.tolist()], dtype=np.int64)
            chars = np.array([rows[i][3][depth - 1] for i in active.tolist()], dtype=np.int64)
            parents = slot[active]
            order = np.lexsort((labels, parents))
            p, q = parents[order], labels[order]
            new = np.r_[True, (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            trie.add(p[new], q[new])
            slot[active] = trie.step(parents, labels)
        here = slot[active]
        # Conversations with a common prefix lie side by side.
        first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
        node = here[first]
        end = lengths[active[first]] == depth
        levels.append({
            "slot": node, "parent": trie.check[node], "depth": np.full(len(node), depth), "chars": chars[first], "end": end, "row": active[first],
            "n_convs": np.add.reduceat(number[active], first), "conv": np.minimum.reduceat(rep[active], first),
            "early": (np.arange(len(node)) == 0) & (active[0] == 0) & (depth <= on_first),
            "late": (np.arange(len(node)) == len(node) - 1) & (active[-1] == len(rows) - 1) & (depth <= on_last)})
    size = int(max(x["slot"].max() for x in levels)) + 1
    conv, children, kids, leaves, saved, shared = (np.zeros(size, dtype=np.int64) for _ in range(6))
    for level in reversed(levels):
        s, own = level["slot"], ~level["early"]
        leaf = (kids[s] == 0) & ~level["late"] & own
        leaves[s] += leaf
        saved[s] += level["n_convs"] * level["chars"] - np.where(own, level["chars"], 0)
        conv[s] = level["conv"]
        shared[s] = level["early"] | level["late"]
        if level["depth"][0]:
            np.add.at(leaves, level["parent"], leaves[s])
            np.add.at(saved, level["parent"], saved[s])
            np.add.at(kids, level["parent"], 1)
            np.add.at(children, level["parent"], own.astype(np.int64))
    out = {k: np.concatenate([x[k] for x in levels]) for k in ("slot", "parent", "depth", "n_convs", "conv", "end", "row")}
    s, p = out["slot"], out["parent"]
    out |= {"n_children": children[s], "n_leaves": leaves[s], "saved": saved[s], "shared": shared[s] > 0}
    out["parent_shared"] = (out["depth"] > 0) & (shared[p] > 0)
    out["parent_conv"] = conv[p]
    return out


def _path_names(keys: list[bytes], upto: int) -> list[str]:
    """A name of each prefix: its depth and hash."""
    state, names = hashlib.sha256(), ["0:"]
    for d, k in enumerate(keys[:upto], 1):
        state.update(k)
        names.append(f"{d}:{state.copy().hexdigest()}")
    return names


_NODES = (
    "name string, parent_name string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint,"
    " saved_tokens bigint, ends string")


def _node_batch(rows: list[tuple], before, after) -> pa.RecordBatch:
    got = shard_nodes(rows, before, after)
    names: list[str | None] = [None] * len(got["slot"])
    parents: list[str | None] = [None] * len(got["slot"])
    path: dict[int, list[str]] = {}
    on_first = _common(rows[0][2], before)
    for i in np.flatnonzero(got["shared"] | got["parent_shared"]).tolist():
        row, depth = int(got["row"][i]), int(got["depth"][i])
        # Shared nodes lie on the paths of the first and the last row.
        if got["shared"][i]:
            if row not in path:
                path[row] = _path_names(rows[row][2], len(rows[row][2]))
            names[i] = path[row][depth]
        if got["parent_shared"][i]:
            edge = 0 if on_first >= depth - 1 and rows[row][2][:depth - 1] == rows[0][2][:depth - 1] else len(rows) - 1
            if edge not in path:
                path[edge] = _path_names(rows[edge][2], len(rows[edge][2]))
            parents[i] = path[edge][depth - 1]
    ends = [rows[r][4] if e else None for r, e in zip(got["row"].tolist(), got["end"].tolist())]
    known = (got["depth"] > 0) & ~got["parent_shared"]
    return pa.record_batch([
        pa.array(names, pa.string()), pa.array(parents, pa.string()), pa.array(got["conv"]), pa.array(got["depth"]),
        pa.array(got["parent_conv"], mask=~known), pa.array(got["n_convs"]), pa.array(got["n_children"]), pa.array(got["n_leaves"]),
        pa.array(got["saved"]), pa.array(ends, pa.string())], names=[c.split()[0] for c in _NODES.split(", ")])


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, is_row, id, number, keys, lengths, ends, before, after), sorted, each shard's neighbours first."""
    now, rows, sides = None, [], (None, None)
    for batch in batches:
        for shard, is_row, conv, n, keys, chars, ends, before, after in zip(*(batch.column(i).to_pylist() for i in range(9))):
            if shard != now:
                if rows:
                    yield _node_batch(rows, *sides)
                now, rows = shard, []
            if is_row:
                rows.append((conv, n, keys, chars, ends))
            else:
                sides = before, after
    if rows:
        yield _node_batch(rows, *sides)


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, ids) rows sorted by digest and block to the hash of each digest's ids, joined by commas."""
    now, state, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if digest != now:
                if state is not None:
                    out.append((now, state.hexdigest()))
                now, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.record_batch([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], names=["digest", "ends"])
        out = []
    if state is not None:
        yield pa.record_batch([pa.array([now]), pa.array([state.hexdigest()])], names=["digest", "ends"])


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, keys, chars): each conversation as one row, with the head of its group's first conversation in front.

    Turns go by ``turn`` (null first), equal ones by role and text hash. A null role or text is empty.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.substring(F.sha2(F.concat_ws(":", F.char_length(r).cast("string"), r, t), 256), 1, 32))
    turns = conversations.select(F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), r.alias("role"), key.alias("key"), F.char_length(t).alias("chars")).alias("it"))
    own = written(turns.where("conv IS NOT NULL").groupBy("conv").agg(F.sort_array(F.collect_list("it")).alias("it")).select(
        "conv", F.transform("it", lambda x: F.struct(x["key"].alias("key"), x["chars"].alias("chars"))).alias("it")), "conversations")
    heads = own.where(f"conv % {GROUP} = 0").select(F.col("conv").alias("first"), F.slice("it", 1, HEAD - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(HEAD)).cast("int")
    both = own.withColumn("first", F.col("conv") - F.col("conv") % GROUP).join(heads, "first", "left")
    none = F.slice("it", 1, 0)
    it = F.concat(F.slice(F.coalesce("head", none), F.lit(1), h), F.slice("it", h + 1, F.greatest(F.size("it") - h, F.lit(0))))
    return both.select("conv", it.alias("it")).select("conv", F.col("it.key").alias("keys"), F.col("it.chars").alias("chars"))


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per distinct prefix of the rebuilt conversations, the empty one (depth 0) included.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the smallest member, the
    number of turns, the parent's smallest member (null for the root), members, direct children, childless nodes below
    or at the node, code points of texts that members after the first repeat, summed below and at the node, and the
    SHA-256 of the ids of the members that end here, ascending and joined by commas.

    Rows without a conversation id belong to no conversation and are left out. Null roles and texts are empty, so such
    turns are turns. Rows with equal turn numbers go by role, then by the hash of the text; repeated rows are repeated
    turns. A conversation is one row and must fit into a task; texts themselves are never moved. Further columns are
    left out, whatever their names. An empty table gives no rows.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = written(rebuilt(conversations, conv, turn, role, text).withColumn("digest", F.sha2(F.array_join(F.transform("keys", F.hex), ""), 256)), "rebuilt")
    groups = all_.groupBy("digest").agg(F.min("conv").alias("conv"), F.count("*").alias("n"))
    block = F.floor(F.col("conv") / BLOCK)
    blocks = (
        all_.select("digest", "conv").join(groups.where("n > 1").select("digest"), "digest")
        .groupBy("digest", block.alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))
    lists = blocks.repartition(parts, "digest").sortWithinPartitions("digest", "block").select("digest", "ids").mapInArrow(_hash_lists, "digest string, ends string")
    alone = F.sha2(F.col("conv").cast("string"), 256)
    rows = groups.join(lists, "digest", "left").select("conv", "n", F.coalesce("ends", alone).alias("ends")).join(all_.drop("digest"), "conv")
    rows = written(rows, "distinct")
    turns = rows.agg(F.sum(F.size("keys"))).first()[0] or 0
    shards = max(parts, -(-turns // SHARD_TURNS))
    sharded = written(rows.repartitionByRange(shards, "keys").withColumn("shard", F.spark_partition_id()), "sharded")
    edges = sharded.groupBy("shard").agg(F.min("keys").alias("low"), F.max("keys").alias("high"))
    order = Window.orderBy("shard")  # one row per shard
    sides = edges.select("shard", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    no = lambda c, kind: F.lit(None).cast(kind).alias(c)
    fed = sides.select(
        "shard", F.lit(False).alias("is_row"), no("conv", "long"), no("n", "long"), no("keys", "array<binary>"), no("chars", "array<int>"), no("ends", "string"), "before", "after"
    ).unionByName(sharded.select("shard", F.lit(True).alias("is_row"), "conv", "n", "keys", "chars", "ends", no("before", "array<binary>"), no("after", "array<binary>")))
    dealt = fed.repartitionById(shards, F.pmod("shard", F.lit(shards))).sortWithinPartitions("shard", "is_row", "keys")
    nodes = written(dealt.mapInArrow(_tries, _NODES), "nodes")
    merged = nodes.where("name IS NOT NULL").groupBy("name", "depth").agg(
        F.max("parent_name").alias("parent_name"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("parent_conv_id").alias("parent_conv_id"), F.max("ends").alias("ends"))
    merged = written(merged, "shared-nodes")
    everything = nodes.where("name IS NULL").unionByName(merged)
    names = merged.select(F.col("name").alias("parent_name"), F.col("conv_id").alias("_above"))
    linked = everything.where("parent_name IS NOT NULL").join(names, "parent_name").withColumn("parent_conv_id", F.col("_above")).drop("_above")
    out = everything.where("parent_name IS NULL").unionByName(linked)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(_NONE)).alias("ends_sha256"))
