"""Alignment of two tokenizers over a corpus, with corpus-wide counts of the token pairs that end together.

1. Align. Documents are dealt to chunks by a hash of the row. A task tokenises its chunks both ways, lays the tokens over
   the text's bytes and takes the pairs whose ends meet. A chunk writes its distinct pairs with their counts, as packed
   arrays, one for each slice of the pairs' hash space, and its documents as packed token ids.
2. Hash. Each slice's distinct pairs get a minimal perfect hash. Its partial counts become dense vectors over the hash's
   indexes, every pair verified against the key stored at its index, and the vectors are summed over a tree: first within a
   branch of chunks, then over branches.
3. Look up. Each chunk's distinct pairs get their corpus-wide counts from the slices, again through the hash with verified
   keys. In a second pass the chunk's documents are aligned again from their token ids, and every link finds its count.

Nothing but the highest count of each id of the second tokenizer (as many numbers as its vocabulary) passes the driver.
Slices and chunks are bounded by the number of bytes, so neither grows with the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark.sql import Column, DataFrame, functions as F
from tokenizers import Tokenizer

from tablesmith.llm.common import written
from tablesmith.llm.pairhash import PairHash, mixed

TOKENIZERS = "/opt/tokenizers"
BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text for each chunk and each slice, and slices that the whole space of pairs needs at most (2^18 pairs each).
CHUNK_BYTES, SLICE_BYTES, SLICE_PAIRS = 16 << 20, 4 << 20, 1 << 18
#: Text that one step of a task tokenises at once, and distinct pairs gathered before they are merged.
_STEP_BYTES, _HELD = 1 << 20, 1 << 20
#: How the byte-level vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_GAP = re.compile(r"\s{1000}")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenPair:
    """Both tokenizers, each token's bytes and its text in a list of groups."""

    def __init__(self, byte_json: bytes, piece_model: bytes) -> None:
        self.byte_json = byte_json
        letters = _byte_letters()
        spec = json.loads(byte_json)
        special = {t["id"] for t in spec["added_tokens"]}
        vocab = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if i not in special}
        self.vocab = vocab
        self.a_bytes = [vocab.get(i, b"") for i in range(max(vocab) + 1)]
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.b_bytes = [self._piece(i) for i in range(self.pieces.get_piece_size())]
        self.a_len = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_len = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        na, nb = len(self.a_bytes), len(self.b_bytes)
        self.texts = [
            *[b"%d," % i for i in range(na)], *[b"%d|" % i for i in range(na)], *[b"%d," % i for i in range(nb)], *[b"%d;" % i for i in range(nb)]]

    @cached_property
    def slow(self) -> Tokenizer:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made = Tokenizer.from_str(self.byte_json.decode())
        made.encode_special_tokens = True
        return made

    @cached_property
    def fast(self) -> tiktoken.Encoding:
        """The same merges as the slow one, in order of ids; it has no room for very long white space."""
        return tiktoken.Encoding("pair", pat_str=PATTERN, mergeable_ranks={t: i for i, t in self.vocab.items()}, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.pieces.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each text by both; two empty lists for empty texts and where the joined bytes are not the text's."""
        a = [self.slow.encode(" " + t, add_special_tokens=False).ids if _LONG_GAP.search(t) else self.fast.encode_ordinary(" " + t) for t in texts]
        b = self.pieces.encode(texts, num_threads=1)
        ab, bb = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        for i, t in enumerate(texts):
            raw = b" " + t.encode()
            if not t or b"".join(map(bb, b[i])) != raw or b"".join(map(ab, a[i])) != raw:
                a[i], b[i] = [], []
        return a, b


class Aligned:
    """Some texts aligned: tokens of all texts end to end, links in text order.

    ``a_ids[a_last[k]]`` and ``b_ids[b_last[k]]`` end together in link k, which ends group k.
    """

    def __init__(self, pair: TokenPair, n_a: np.ndarray, n_b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray) -> None:
        self.pair, self.n_a, self.n_b, self.a_ids, self.b_ids = pair, n_a, n_b, a_ids, b_ids
        # Both cover the same bytes, so ends of all texts laid end to end meet only within a text.
        ends_a, ends_b = np.cumsum(pair.a_len[self.a_ids]), np.cumsum(pair.b_len[self.b_ids])
        at = np.searchsorted(ends_b, ends_a)
        meets = ends_b[np.minimum(at, max(len(ends_b) - 1, 0))] == ends_a if len(ends_b) else np.zeros(0, dtype=bool)
        self.a_last = np.flatnonzero(meets)
        self.b_last = at[meets]
        self.text = np.repeat(np.arange(len(n_a)), n_a)[self.a_last]
        self.n_groups = np.bincount(self.text, minlength=len(n_a))
        self.keys = self.a_ids[self.a_last] << 16 | self.b_ids[self.b_last]

    @classmethod
    def of(cls, pair: TokenPair, texts: list[str]) -> "Aligned":
        lists = pair.encode(texts)
        counts = [np.array([len(x) for x in some], dtype=np.int64) for some in lists]
        return cls(pair, *counts, *[np.fromiter((i for x in some for i in x), dtype=np.int64, count=int(n.sum())) for some, n in zip(lists, counts)])

    def packed(self) -> bytes:
        """Token numbers and ids, squeezed; ids fit into 16 bits."""
        return zstandard.compress(b"".join([
            np.r_[self.n_a, self.n_b].astype(np.int32).tobytes(), self.a_ids.astype(np.uint16).tobytes(), self.b_ids.astype(np.uint16).tobytes()]))

    @classmethod
    def unpacked(cls, pair: TokenPair, texts: int, data: bytes) -> "Aligned":
        raw = zstandard.decompress(data)
        n = np.frombuffer(raw, dtype=np.int32, count=2 * texts).astype(np.int64)
        ids = np.frombuffer(raw, dtype=np.uint16, offset=8 * texts).astype(np.int64)
        cut = int(n[:texts].sum())
        return cls(pair, n[:texts], n[texts:], ids[:cut], ids[cut:])

    def groups(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        na, nb = len(self.pair.a_bytes), len(self.pair.b_bytes)
        a_ends, b_ends = np.zeros(len(self.a_ids), dtype=np.int64), np.zeros(len(self.b_ids), dtype=np.int64)
        a_ends[self.a_last], b_ends[self.b_last] = 1, 1
        a_group, b_group = np.cumsum(a_ends) - a_ends, np.cumsum(b_ends) - b_ends
        b_before, a_until = np.r_[0, self.b_last + 1], np.r_[self.a_last + 1, len(self.a_ids)]
        codes = np.empty(len(self.a_ids) + len(self.b_ids), dtype=np.int64)
        codes[np.arange(len(self.a_ids)) + b_before[a_group]] = self.a_ids + na * a_ends
        codes[np.arange(len(self.b_ids)) + a_until[b_group]] = 2 * na + self.b_ids + nb * b_ends
        words = list(map(self.pair.texts.__getitem__, codes.tolist()))
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        return [b"".join(words[s:e])[:-1] for s, e in zip([0, *stops[:-1]], stops)]


def _steps(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a step's size."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= _STEP_BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _longs(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Load:
    """Tokenizers made in the task from the files' bytes, so that executors need no copy of the files."""

    def __init__(self, folder: str) -> None:
        with open(os.path.join(folder, BYTE_FILE), "rb") as f, open(os.path.join(folder, PIECE_FILE), "rb") as g:
            self.files = f.read(), g.read()

    def __call__(self) -> TokenPair:
        return TokenPair(*self.files)


_PARTS = "chunk int, slice int, keys binary, counts binary, docs array<bigint>, tokens binary"


def _pairs(load: _Load, slices: int):
    """Rows (chunk, doc, text) sorted by chunk to each chunk's documents, and its distinct pairs and counts by slice."""
    names = [c.split()[0] for c in _PARTS.split(", ")]

    def counted(chunk: int, held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _summed(held)
        part = (mixed(keys) % np.uint64(slices)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, keys, counts = part[order], keys[order], counts[order]
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, dtype=np.int64)
        bounds = list(zip(first, np.r_[first[1:], len(part)]))
        n = len(bounds)
        return pa.record_batch([
            pa.array([chunk] * n, pa.int32()), pa.array(part[first].astype(np.int32)),
            pa.array([keys[s:e].tobytes() for s, e in bounds], pa.binary()), pa.array([counts[s:e].tobytes() for s, e in bounds], pa.binary()),
            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, now, held = None, None, []
        for batch in batches:
            chunks, docs, texts = (batch.column(i).to_pylist() for i in range(3))
            pair = pair or load()
            changes = [i for i in range(len(chunks)) if i == 0 or chunks[i] != chunks[i - 1]]
            for s, e in zip(changes, [*changes[1:], len(chunks)]):
                if chunks[s] != now:
                    if held:
                        yield counted(now, held)
                    now, held = chunks[s], []
                mine = [t or "" for t in texts[s:e]]
                for x, y in _steps(mine):
                    got = Aligned.of(pair, mine[x:y])
                    held.append(np.unique(got.keys, return_counts=True))
                    if len(held) > 1 and sum(len(k) for k, _ in held) > _HELD:
                        held = [_summed(held)]
                    yield pa.record_batch([
                        pa.array([now], pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()),
                        pa.array([docs[s + x:s + y]], pa.list_(pa.int64())), pa.array([got.packed()], pa.binary())], names=names)
        if held:
            yield counted(now, held)

    return run


def _by_key(columns: int, flush):
    """Rows sorted by their first column to ``flush(key, rows)`` for each key, rows one by one as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(columns)))

        stream = rows()
        row = next(stream, None)
        while row is not None:
            key, ahead = row[0], [row]

            def group():
                while ahead[0] is not None and ahead[0][0] == key:
                    yield ahead[0]
                    ahead[0] = next(stream, None)

            yield flush(key, group())
            for _ in group():
                pass
            row = ahead[0]

    return run


def _union(key, rows) -> pa.RecordBatch:
    """(branch, keys) rows to one with the distinct keys."""
    held: list[np.ndarray] = []
    for _, keys in rows:
        held.append(_longs(keys))
        if len(held) > 1 and sum(map(len, held)) > _HELD:
            held = [np.unique(np.concatenate(held))]
    return pa.record_batch([pa.array([key], pa.int64()), pa.array([np.unique(np.concatenate(held)).tobytes()], pa.binary())], names=["key", "keys"])


def _hashed(key, rows) -> pa.RecordBatch:
    """(slice, keys) rows to the slice's hash and its keys in index order."""
    keys = np.unique(np.concatenate([_longs(k) for _, k in rows]))
    table = PairHash.build(keys)
    return pa.record_batch(
        [pa.array([key], pa.int64()), pa.array([table.to_bytes()], pa.binary()), pa.array([table.ordered(keys).tobytes()], pa.binary())], names=["slice", "hash", "keys"])


def _dense(key, rows) -> pa.RecordBatch:
    """(branch, is_part, hash, keys, counts) rows, the hash first, to the branch's dense count vector."""
    table = stored = total = None
    for _, is_part, data, keys, counts in rows:
        if not is_part:
            table, stored = PairHash.from_bytes(data), _longs(keys)
            total = np.zeros(table.size, dtype=np.int64)
            continue
        at = table.verified(_longs(keys), stored)
        if (at < 0).any():
            raise ValueError("a pair is missing from its slice's hash")
        total[at] += _longs(counts)
    return pa.record_batch([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["key", "counts"])


def _total(key, rows) -> pa.RecordBatch:
    """(slice, counts) rows to the sum of the vectors."""
    total = None
    for _, counts in rows:
        total = _longs(counts).copy() if total is None else total + _longs(counts)
    return pa.record_batch([pa.array([key], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (branch, is_part, hash, keys, counts, chunk), each branch's hash first, to each chunk's counts."""
    table = stored = counts = None
    for batch in batches:
        out = []
        for is_part, data, keys, known, chunk in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
            if not is_part:
                table, stored, counts = PairHash.from_bytes(data), _longs(keys), _longs(known)
                continue
            at = table.verified(_longs(keys), stored)
            if (at < 0).any():
                raise ValueError("a pair is missing from its slice's hash")
            out.append((chunk, keys, counts[at].tobytes()))
        kinds = [pa.int32(), pa.binary(), pa.binary()]
        yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["chunk", "keys", "counts"])


def _highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(keys, counts) of slices to the highest count of each second id."""
    for batch in batches:
        for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            b, n = _longs(keys) & 0xFFFF, _longs(counts)
            order = np.lexsort((n, b))
            last = np.flatnonzero(np.r_[b[order][1:] != b[order][:-1], True]) if len(b) else np.zeros(0, dtype=np.int64)
            yield pa.record_batch([pa.array(b[order][last]), pa.array(n[order][last])], names=["b", "n"])


_RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string, groups string"


def _looked_up(load: _Load, highest: np.ndarray, with_groups: bool):
    """Rows (chunk, is_doc, docs, tokens, keys, counts), sorted by chunk with its counts first, to a row per document."""
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def found(got: Aligned, docs: list, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        n = np.zeros(0, dtype=np.int64)
        if len(got.keys):
            at = np.minimum(np.searchsorted(keys, got.keys), len(keys) - 1)
            if not (keys[at] == got.keys).all():
                raise ValueError("a link has no count")
            n = counts[at]
        best, total = np.zeros((2, len(docs)), dtype=np.int64)
        np.add.at(best, got.text, n == highest[got.keys & 0xFFFF])
        np.add.at(total, got.text, n)
        groups = got.groups()
        links = got.n_groups.astype(np.int64)
        return pa.record_batch([
            pa.array(docs, pa.int64()), pa.array(got.n_a), pa.array(got.n_b), pa.array(links), pa.array(links), pa.array(best), pa.array(total),
            pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups], pa.string()),
            pa.array([g.decode() if with_groups else None for g in groups], pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, now, held = None, None, []
        keys = counts = np.zeros(0, dtype=np.int64)
        for batch in batches:
            pair = pair or load()
            for chunk, is_doc, docs, tokens, some, known in zip(*(batch.column(i) for i in range(6))):
                if chunk.as_py() != now:
                    now, held = chunk.as_py(), []
                    keys = counts = np.zeros(0, dtype=np.int64)
                if not is_doc.as_py():
                    held.append((_longs(some.as_py()), _longs(known.as_py())))
                    continue
                if held:
                    keys, counts = _summed(held)
                    held = []
                docs = docs.as_py()
                yield found(Aligned.unpacked(pair, len(docs), tokens.as_py()), docs, keys, counts)

    return run


def _dealt(df: DataFrame, parts: int, key: Column, *order: str) -> DataFrame:
    """Rows of equal ``key`` in one of ``parts`` partitions, keys evenly dealt, partitions sorted by ``order``."""
    return df.repartitionById(parts, F.pmod(key, F.lit(parts)).cast("int")).sortWithinPartitions(*order)


class Alignment:
    """The aligned corpus: counts of all pairs, and rows for documents."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> None:
        spark = docs.sparkSession
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.load = _Load(folder)
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.chunks = max(self.parts, -(-size // CHUNK_BYTES))
        space = len(TokenPair(*self.load.files).texts) // 2
        self.slices = max(1, min(-(-size // SLICE_BYTES), -(-(space * space // 4) // SLICE_PAIRS)))
        doc, text = F.col(id_col).cast("long"), F.col(text_col)
        rows = docs.select(F.pmod(F.xxhash64(doc, text), F.lit(self.chunks)).cast("int").alias("chunk"), doc.alias("doc"), text.alias("text"))
        first = written(_dealt(rows, self.parts, F.col("chunk"), "chunk").mapInArrow(_pairs(self.load, self.slices), _PARTS), "aligned")
        self.partials = first.where("docs IS NULL").select("chunk", "slice", "keys", "counts")
        self.docs = first.where("docs IS NOT NULL").select("chunk", "docs", "tokens")
        self.table = written(self._count(), "pair-counts")
        top = self.table.select("keys", "counts").mapInArrow(_highest, "b bigint, n bigint").groupBy("b").agg(F.max("n").alias("n"))
        self.highest = np.zeros(1 << 16, dtype=np.int64)
        for b, n in top.collect():  # one number for each id of the second vocabulary
            self.highest[b] = n

    def _count(self) -> DataFrame:
        """(slice, hash, keys, counts): each slice's hash, with keys and counts in index order."""
        self.branches = max(1, round(self.chunks**0.5))
        branch = F.col("slice").cast("long") * self.branches + F.col("chunk") % self.branches
        parts = self.partials.select(branch.alias("key"), "slice", "keys", "counts")
        some = _dealt(parts.select("key", "keys"), self.parts, F.col("key"), "key").mapInArrow(_by_key(2, _union), "key bigint, keys binary")
        some = some.select(F.floor(F.col("key") / self.branches).alias("slice"), "keys")
        hashes = written(
            _dealt(some, self.parts, F.col("slice"), "slice").mapInArrow(_by_key(2, _hashed), "slice bigint, hash binary, keys binary"), "pair-hashes")
        each = parts.select("key").distinct().select("key", F.floor(F.col("key") / self.branches).alias("slice"))
        rows = each.join(hashes, "slice").select("key", F.lit(False).alias("is_part"), "hash", "keys", F.lit(None).cast("binary").alias("counts")).unionByName(
            parts.select("key", F.lit(True).alias("is_part"), F.lit(None).cast("binary").alias("hash"), "keys", "counts"))
        vectors = _dealt(rows, self.parts, F.col("key"), "key", "is_part").mapInArrow(_by_key(5, _dense), "key bigint, counts binary")
        vectors = vectors.select(F.floor(F.col("key") / self.branches).alias("slice"), "counts")
        totals = _dealt(vectors, self.parts, F.col("slice"), "slice").mapInArrow(_by_key(2, _total), "slice bigint, counts binary")
        return hashes.join(totals, "slice")

    def pairs(self) -> DataFrame:
        """(a, b, n, best): how many links hold each pair of ids, and whether ``n`` is the highest of its second id."""
        highest = self.highest

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    k, n = _longs(keys), _longs(counts)
                    yield pa.record_batch(
                        [pa.array((k >> 16).astype(np.int32)), pa.array((k & 0xFFFF).astype(np.int32)), pa.array(n), pa.array(n == highest[k & 0xFFFF])], names=["a", "b", "n", "best"])

        return self.table.select("keys", "counts").mapInArrow(run, "a int, b int, n bigint, best boolean")

    def documents(self, with_groups: bool = True) -> DataFrame:
        """A row per document, see ``align``."""
        branch = F.col("slice").cast("long") * self.branches + F.col("chunk") % self.branches
        none = F.lit(None).cast("binary")
        parts = self.partials.select(branch.alias("key"), F.lit(True).alias("is_part"), none.alias("hash"), "keys", none.alias("counts"), "chunk")
        each = parts.select("key").distinct().select("key", F.floor(F.col("key") / self.branches).alias("slice"))
        tables = each.join(self.table, "slice").select("key", F.lit(False).alias("is_part"), "hash", "keys", "counts", F.lit(None).cast("int").alias("chunk"))
        found = _dealt(tables.unionByName(parts), self.parts, F.col("key"), "key", "is_part").mapInArrow(_found, "chunk int, keys binary, counts binary")
        rows = found.select("chunk", F.lit(False).alias("is_doc"), F.lit(None).cast("array<bigint>").alias("docs"), none.alias("tokens"), "keys", "counts").unionByName(
            self.docs.select("chunk", F.lit(True).alias("is_doc"), "docs", "tokens", none.alias("keys"), none.alias("counts")))
        return _dealt(rows, self.parts, F.col("chunk"), "chunk", "is_doc").mapInArrow(_looked_up(self.load, self.highest, with_groups), _RESULT)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS, with_groups: bool = True) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups) per row of ``docs``.

    Tokens of the byte-level tokenizer (a) and of the piece tokenizer (b) are laid over the bytes of a space and the text.
    Where one of each ends at the same byte a group ends, and the two are linked. ``n_best``: links whose pair is the
    most frequent of its second id in the corpus, ties included. ``count_sum``: the links' corpus-wide counts, summed.
    ``groups`` (null unless ``with_groups``) reads ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and texts that a tokenizer does not give back byte by byte, have no tokens: zeros and ''. Rows
    without an id and repeated rows are rows like any other and count as often as they occur. Texts are never cut: a
    very long one is one step of one task. Further columns are left out, whatever their names. An empty table gives none.
    """
    return Alignment(docs, id_col, text_col, folder).documents(with_groups)
