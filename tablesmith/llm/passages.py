"""Repeated passages: windows of words that an earlier document has, found with sharded Aho-Corasick automata.

1. Confirm. Each window of ``n`` words is dealt by its anchor, the word group of ``ANCHOR`` words with the smallest hash in
   it, which equal windows share; neighbouring windows mostly share their anchor and travel as one row. Sorted by
   anchor, the first document of every window and the document shards in which it recurs fall out of one pass.
   Anchors that a bounded sample shows in many documents are dealt over several keys; what a part cannot decide, an
   aggregate over the parts does, so the sample steers only where rows go.
2. Compile. The first document's recurring windows, joined to passages, go to each document shard where they recur. A
   shard's passages become one automaton over word numbers. Its patterns are the passages' tiles of (n + 1) / 2 words:
   each window of ``n`` words holds a whole tile.
3. Stream. A shard's documents run through its automaton; each tile found is extended, word by word, to the stretch that
   the document shares with the passage. Stretches of at least ``n`` words are removed. Words are compared as they are,
   so hashes decide only which passages are compiled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.llm.common import written

N, ANCHOR = 13, 5
#: Documents in the sample that finds hot anchors, and the share of them that makes an anchor hot.
SAMPLE_DOCS, HOT_SHARE, SALTS = 2000, 0.005, 32
#: Document shards for each shuffle partition.
SHARDS = 4
_OUT_ROWS = 200_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - n + 1 + i]
    return _mixed(out)


class WordHashes(dict):
    """Hashes of words, each worked out once for as long as there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def window_runs(text: bytes | None, n: int = N, anchor: int = ANCHOR, known: WordHashes | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(anchor, first start, number of windows) of each run of windows, and 32 bits of each window's hash."""
    words = (text or b"").split()
    if len(words) < n:
        return None
    known = WordHashes() if known is None else known
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    small = _grams(h, anchor)
    at = sliding_window_view(small, n - anchor + 1).argmin(axis=1) + np.arange(len(h) - n + 1)
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return small[at[starts]].view(np.int64), starts, np.diff(np.r_[starts, len(at)]), (_grams(h, n) >> np.uint64(32)).astype(np.uint32)


_RUN = "anchor bigint, salt int, doc bigint, shard int, start int, rest binary"


def _runs(hot: np.ndarray, n: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            docs, shards, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())
            held, size = [], 0
            for i, (doc, shard) in enumerate(zip(docs, shards)):
                got = window_runs(texts[i].as_py(), n, anchor, known)
                if got is None:
                    continue
                a, starts, counts, rest = got
                salt = np.where(np.isin(a, hot), shard % SALTS + 1, 0).astype(np.int32) if len(hot) else np.zeros(len(a), np.int32)
                held.append((a, salt, np.full(len(a), doc), np.full(len(a), shard, np.int32), starts.astype(np.int32), counts, rest))
                size += len(a)
                if size >= _OUT_ROWS:
                    yield _run_batch(held)
                    held, size = [], 0
            if held:
                yield _run_batch(held)

    return run


def _run_batch(held: list[tuple]) -> pa.RecordBatch:
    a, salt, doc, shard, start, counts, rest = (np.concatenate(x) for x in zip(*held))
    offsets = np.r_[0, np.cumsum(counts * 4)].astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rest.tobytes())])
    return pa.record_batch(
        [pa.array(a), pa.array(salt), pa.array(doc), pa.array(shard), pa.array(start), binary], names=["anchor", "salt", "doc", "shard", "start", "rest"])


#: open: the rows of part keys that the parts' minima have yet to decide. mask: starts 16 * block + bit.
_FOUND = "open boolean, anchor bigint, window bigint, source bigint, shard int, block int, mask int"


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, salt) to the first documents of windows and the shards where they recur."""
    held: list[pa.RecordBatch] = []

    def table(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(rows).combine_chunks()
        return tuple(t.column(i).to_numpy() for i in range(5)), t.column(5).combine_chunks() if t.num_rows else None

    def decide(rows: list[pa.RecordBatch]):
        (anchor, salt, doc, shard, start), rest = table(rows)
        if rest is None or not len(anchor):
            return
        if isinstance(rest, pa.ChunkedArray):
            rest = rest.chunk(0)
        offsets = np.frombuffer(rest.buffers()[1], dtype=np.int32)[rest.offset:rest.offset + len(rest) + 1]
        bits = np.frombuffer(rest.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]].view(np.uint32)
        counts = np.diff(offsets) // 4
        row = np.repeat(np.arange(len(anchor)), counts)
        group = np.cumsum(np.r_[True, (anchor[1:] != anchor[:-1]) | (salt[1:] != salt[:-1])])[row]
        begin = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        order = np.lexsort((begin, doc[row], bits, group))
        row, group, bits, begin = row[order], group[order], bits[order], begin[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (bits[1:] != bits[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        source, at = doc[row[first]], begin[first]
        hits = doc[row] > source
        if hits.any():
            yield _packed(source[hits], shard[row][hits], at[hits])
        undecided = new & (salt[row] > 0)
        if undecided.any():
            r = row[undecided]
            yield pa.record_batch([
                pa.array(np.ones(len(r), bool)), pa.array(anchor[r]), pa.array(bits[undecided].astype(np.int64)), pa.array(doc[r]),
                pa.array(shard[r]), pa.array((begin[undecided] >> 4).astype(np.int32)), pa.array((1 << (begin[undecided] & 15)).astype(np.int32))], names=_names())

    for batch in batches:
        if not batch.num_rows:
            continue
        a, s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # The last key may go on in the next batch.
        cut = int(np.flatnonzero((a != a[-1]) | (s != s[-1]))[-1]) + 1 if ((a != a[-1]) | (s != s[-1])).any() else 0
        if cut or (held and (held[-1].column(0)[-1].as_py(), held[-1].column(1)[-1].as_py()) != (a[-1], s[-1])):
            yield from decide([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield from decide(held)


def _names() -> list[str]:
    return [c.split()[0] for c in _FOUND.split(", ")]


def _packed(source: np.ndarray, shard: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    block = at >> 4
    order = np.lexsort((block, shard, source))
    source, shard, block, mask = source[order], shard[order], block[order], (1 << (at[order] & 15)).astype(np.int32)
    new = np.flatnonzero(np.r_[True, (source[1:] != source[:-1]) | (shard[1:] != shard[:-1]) | (block[1:] != block[:-1])])
    n = len(new)
    zero = np.zeros(n, np.int64)
    return pa.record_batch([
        pa.array(np.zeros(n, bool)), pa.array(zero), pa.array(zero), pa.array(source[new]), pa.array(shard[new].astype(np.int32)),
        pa.array(block[new].astype(np.int32)), pa.array(np.bitwise_or.reduceat(mask, new))], names=_names())


def _cut_passages(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last, words = None, []
            for shard, source, starts, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).cast(pa.binary())):
                raw = text.as_py() or b""
                if raw is not last:
                    last, words = raw, raw.split()
                at = np.array(sorted(16 * x["block"] + b for x in starts for b in range(16) if x["mask"] >> b & 1))
                at = at[at <= len(words) - n]
                if not len(at):
                    continue
                ends = np.flatnonzero(np.diff(at) > 1)
                found = [b" ".join(words[at[s]:at[e] + n]) for s, e in zip(np.r_[0, ends + 1], np.r_[ends, len(at) - 1])]
                yield pa.record_batch([
                    pa.array([shard] * len(found), pa.int32()), pa.array([source] * len(found), pa.int64()),
                    pa.array([f.decode() for f in found], pa.string())], names=["shard", "doc", "text"])

    return run


#: Size of the table of word pairs; other pairs in the same place only cost time.
_PAIRS = 1 << 22


def _pair_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77 >> 7) & (_PAIRS - 1)


class PassageShard:
    """The passages of one document shard as an automaton over word numbers."""

    def __init__(self, n: int = N) -> None:
        self.n, self.tile = n, (n + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.passages: list[tuple[int, tuple[int, ...]]] = []
        self.tiles: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        self.automaton = None

    def add(self, source: int, text: bytes) -> None:
        numbers = self.numbers
        ids = tuple(numbers.setdefault(w, len(numbers) + 1) for w in text.split())
        at = len(self.passages)
        self.passages.append((source, ids))
        for i in range(0, len(ids) - self.tile + 1, self.tile):
            self.tiles.setdefault(ids[i:i + self.tile], []).append((at, i))

    def compile(self) -> None:
        if self.tiles:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, places in self.tiles.items():
                places.sort(key=lambda p: (-len(self.passages[p[0]][1]), p))
                self.automaton.add_word(key, places)
            self.automaton.make_automaton()
            keys = np.array(list(self.tiles), dtype=np.int64)
            self.pairs = np.zeros(_PAIRS, dtype=np.uint8)
            self.pairs[_pair_places(keys[:, :-1], keys[:, 1:])] = 1
        self.tiles = {}

    def stretches(self, ids: list[int]) -> list[tuple[int, int]]:
        """Where a tile can lie: runs of words that follow each other in some tile, looked up in a table of word pairs."""
        at = np.array(ids, dtype=np.int64)
        good = self.pairs[_pair_places(at[:-1], at[1:])].tobytes()
        least, found, start = self.tile - 1, [], 0
        while (start := good.find(b"\x01" * least, start)) >= 0:
            end = good.find(b"\x00", start)
            end = len(good) if end < 0 else end
            found.append((start, end + 1))
            start = end
        return found

    def covered(self, doc: int, words: list[bytes]) -> bytearray:
        """1 for each word in a stretch of at least n words that a passage of a smaller document shares.

        A window found through a tile lies within n - tile words around it. A tile with all of these covered already
        adds nothing, and a tile's longest passages come first, so among many near copies few are extended.
        """
        size = len(words)
        gone = bytearray(size)
        if self.automaton is None or size < self.n:
            return gone
        get, passages, around = self.numbers.get, self.passages, self.n - self.tile
        listed = [get(w, 0) for w in words]
        where = self.stretches(listed)
        if not where:
            return gone
        ids = tuple(listed)
        reached: dict[tuple[int, int], int] = {}
        for end, places in ((s + i, p) for s, e in where for i, p in self.automaton.iter(ids[s:e])):
            begin = end - self.tile + 1
            low, high = max(begin - around, 0), end + around + 1
            for passage, offset in places:
                if gone.find(0, low, high) < 0:
                    break
                source, text = passages[passage]
                if source >= doc:
                    continue
                diagonal = (passage, begin - offset)
                if reached.get(diagonal, -1) >= end:
                    continue
                left, right = 0, end + 1
                while left < offset and begin - left > 0 and ids[begin - left - 1] == text[offset - left - 1]:
                    left += 1
                shift = offset - begin
                while right < size and right + shift < len(text) and ids[right] == text[right + shift]:
                    right += 1
                reached[diagonal] = right - 1
                if right - (begin - left) >= self.n:
                    gone[begin - left:right] = b"\x01" * (right - begin + left)
        return gone


_RESULT = "doc bigint, n_words bigint, n_removed bigint, kept string, kept_sha256 string"


def _stream(n: int, with_text: bool):
    """Rows sorted by shard, passages before documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, PassageShard(n)
        ready = False
        for batch in batches:
            rows = []
            for number, is_doc, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary())):
                if number != now:
                    now, shard, ready = number, PassageShard(n), False
                raw = text.as_py() or b""
                if not is_doc:
                    shard.add(doc, raw)
                    continue
                if not ready:
                    shard.compile()
                    ready = True
                words = raw.split()
                gone = shard.covered(doc, words) if doc is not None else bytearray(len(words))
                removed = sum(gone)
                kept = b" ".join([w for w, g in zip(words, gone) if not g] if removed else words)
                rows.append((doc, len(words), removed, kept.decode() if with_text else None, hashlib.sha256(kept).hexdigest()))
            names = [c.split()[0] for c in _RESULT.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return run


def _shard(doc: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) per row of ``docs``.

    ``kept`` (null unless ``with_text``) holds the words that no window of ``n`` words covers whose words in a row also
    start in a document with a smaller id. Null, empty and shorter texts lose nothing. Rows without an id lose
    nothing and take nothing from others; rows with the same id take nothing from each other. Further columns are left
    out. An empty table gives none.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = SHARDS * parts
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), _shard(F.col(id_col).cast("long"), shards).alias("shard"), F.col(text_col).alias("text"))
    known = rows.where("doc IS NOT NULL AND text IS NOT NULL")
    count = known.select("doc").count()
    sample = known.sample(fraction=min(1.0, SAMPLE_DOCS / max(count, 1)), seed=1).mapInArrow(_runs(np.zeros(0, np.int64), n, ANCHOR), _RUN)
    often = max(20, int(HOT_SHARE * SAMPLE_DOCS))
    hot = np.array(sorted(r[0] for r in sample.groupBy("anchor").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= often).select("anchor").collect()), dtype=np.int64)
    runs = known.mapInArrow(_runs(hot, n, ANCHOR), _RUN)
    found = written(runs.repartition("anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_confirm, _FOUND), "windows")
    undecided = found.where("open").select("anchor", "window", "source", "shard", F.struct("source", "block", "mask").alias("me"))
    least = undecided.groupBy("anchor", "window").agg(F.min("me").alias("first"))
    late = undecided.join(least, ["anchor", "window"]).where("first.source < source").select(
        F.col("first.source").alias("source"), "shard", F.col("first.block").alias("block"), F.col("first.mask").alias("mask"))
    needs = (
        found.where("NOT open").select("source", "shard", "block", "mask").unionByName(late)
        .groupBy("source", "shard", "block").agg(F.bit_or("mask").alias("mask"))
        .groupBy("source", "shard").agg(F.collect_list(F.struct("block", "mask")).alias("starts")))
    texts = known.select(F.col("doc").alias("source"), "text")
    passages = written(needs.join(texts, "source").select("shard", "source", "starts", "text").mapInArrow(_cut_passages(n), "shard int, doc bigint, text string"), "passages")
    # Rows without an id have no shard of their own; any will do.
    all_rows = passages.select("shard", F.lit(False).alias("is_doc"), "doc", "text").unionByName(
        rows.select(F.coalesce("shard", F.lit(0)).alias("shard"), F.lit(True).alias("is_doc"), "doc", "text"))
    streamed = all_rows.repartition(parts, "shard").sortWithinPartitions("shard", "is_doc").mapInArrow(_stream(n, with_text), _RESULT)
    return streamed.withColumnRenamed("doc", "doc_id")
