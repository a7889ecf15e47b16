"""Log-bilinear language model: log-probabilities of whole texts, learned from the training fold.

The most frequent tokens (heads) are classes of their own. All other tokens that occur at least ``SEEN`` times, however many
there are, fall into groups by the company they keep: heads that stand near the same heads form a group, and a token joins the group whose company
makes its own most likely. One class is left for rarer tokens and those never seen. Within a class a token has its
smoothed share of counts. The next class is predicted from the two before it: each context word's vector, weighted by
position, is added up and compared with every output vector. Weights are learned by noise-contrastive estimation over the
trigram counts of the whole training fold: the counts are dealt into shares, a task draws as many trigrams as its share holds
tokens, and the weights are averaged by tokens after every round. Contexts are pairs of classes, so batches of matrix
products give the exact normaliser of every context, and the log-probabilities sum to 1 over all tokens.

What is gathered grows with the corpus: draws with its tokens, the table of token classes with its vocabulary, heads and
groups with the fifth root of its tokens. Counts and classes of all tokens stay distributed. The ``FREQUENT`` most frequent ones are
numbered by a broadcast; the others are joined, and none of them can be a hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tablesmith.llm.common import fold, written

#: Stands for the end of a text; no word holds a line break.
END = b"\n"
#: The least number of heads and groups; ``class_numbers`` says how they grow. ``FREQUENT`` tokens are numbered by a broadcast.
HEADS, GROUPS, FREQUENT = 239, 16, 65536
#: So many places before and after a token belong to its company.
REACH = 4
#: Tokens seen less often join no group: their class is that of tokens not seen at all.
SEEN = 4
#: Draws per token of the training texts, over all rounds; a small corpus still gets ``STEPS`` steps a round.
PASSES = 1.0
DIM, NOISE, STEPS, ROUNDS, BATCH, RATE = 16, 128, 300, 5, 2048, 0.05
#: A Gaussian prior around vectors of zero and the classes' own shares, which counts as much as so many tokens.
PULL = 2.0
#: Rows of one matrix product: small enough that it stays on the task's own thread.
_BLOCK = 128
#: Steps whose trigrams are drawn at once.
_DRAWN = 64
_OUT_ROWS, _OUT_BYTES = 50_000, 1 << 24
_GAP = np.iinfo(np.int32).min
_CODED = "key bigint, doc bigint, held_out boolean, ids binary, words array<binary>"
_CODED_NAMES = [c.split()[0] for c in _CODED.split(", ")]
_CODED_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.list_(pa.binary())]


def class_numbers(total: int) -> tuple[int, int]:
    """Heads and groups for so many tokens: both grow with the fifth root, so tables over pairs of classes with n ** 0.4."""
    heads = max(HEADS, round(6.5 * total**0.2))
    return heads, max(GROUPS, heads // 15)


def share_tokens(total: int) -> int:
    """Tokens whose trigrams one task learns from: shares and their number both grow with the corpus."""
    return max(STEPS * ROUNDS * BATCH, round(100 * total**0.5))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out():
        return pa.record_batch([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for t in batch.column(0).cast(pa.binary()):
            counts.update(tokens(t.as_py()))
            if len(counts) > 200_000:
                yield out()
                counts = Counter()
    yield out()


@dataclass
class Model:
    """What scoring needs besides the table of the other tokens."""

    words: list[bytes]  # the frequent tokens by number
    counts: np.ndarray
    labels: np.ndarray  # class of each frequent token
    whole: np.ndarray  # what counts are divided by in each class
    total: int
    distinct: int
    near: np.ndarray  # [class one before, next class]
    far: np.ndarray  # [class two before, next class]; the bias is in it
    norm: np.ndarray  # [class two before, class one before]

    @property
    def rare(self) -> int:
        return self.near.shape[1] - 1

    def class_log10(self, classes: np.ndarray, starts: np.ndarray | None = None) -> np.ndarray:
        """Of one text, or of several that begin at ``starts``."""
        height, width = self.near.shape
        one, two = _before(classes, np.zeros(min(1, len(classes)), dtype=np.int64) if starts is None else starts, height - 1)
        near, far = self.near.ravel().take(one * width + classes), self.far.ravel().take(two * width + classes)
        return (near + far - self.norm.ravel().take(two * height + one)) / np.log(10)


def _coded(shared):
    """For each text its tokens' numbers; ``-1 - j`` stands for the ``j``-th of the text's distinct tokens that have no number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, press = shared.value.get, zstandard.ZstdCompressor(level=1).compress
        rows: list[tuple] = []
        held_bytes = 0

        def out():
            return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_CODED_TYPES)], names=_CODED_NAMES)

        for batch in batches:
            for key, doc, held, t in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3).cast(pa.binary())):
                ws = tokens(t.as_py())
                ids = np.fromiter(map(get, ws, repeat(-1)), np.int32, len(ws))
                at = np.flatnonzero(ids < 0)
                others: dict[bytes, int] = {}
                if len(at):
                    ids[at] = [-1 - others.setdefault(ws[i], len(others)) for i in at.tolist()]
                rows.append((key, doc, held, press(ids.tobytes()), list(others)))
                held_bytes += ids.nbytes + sum(map(len, others))
                if len(rows) >= _OUT_ROWS or held_bytes >= _OUT_BYTES:
                    yield out()
                    rows, held_bytes = [], 0
        if rows:
            yield out()

    return run


def coded(docs: DataFrame, shared, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All texts, read once more and written as token numbers, with their distinct tokens that have no number."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("doc"),
        held_out.alias("held_out"), F.col(text_col).alias("t"))
    return written(rows.mapInArrow(_coded(shared), _CODED), "coded")


def _numbers(column) -> Iterator[np.ndarray]:
    whole = zstandard.ZstdDecompressor().decompress
    for ids in column:
        yield np.frombuffer(whole(ids.as_buffer()), dtype=np.int32)


def _stretches(batches: Iterator[pa.RecordBatch], tokens_at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Texts (ids, words) put together with gaps between: their numbers, and the distinct other tokens that ``-1 - j`` point to."""
    held, words, size = [], [], 0

    def out():
        found = pa.concat_arrays(words).dictionary_encode()
        codes = found.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        ids = np.concatenate(held)
        other = (ids < 0) & (ids != _GAP)
        ids[other] = -1 - codes[-1 - ids[other]]
        return ids, found.dictionary

    gap, base = np.full(REACH, _GAP, dtype=np.int32), 0
    for batch in batches:
        columns = zip(_numbers(batch.column(0)), np.diff(batch.column(1).offsets.to_numpy()).tolist())
        words.append(batch.column(1).flatten())
        for ids, n in columns:
            held += (np.where(ids < 0, ids - base, ids), gap)
            base += n
            size += len(ids)
        if size > tokens_at_once:
            yield out()
            held, words, size, base = [], [], 0, 0
    if held:
        yield out()


def _pairs(rows: np.ndarray, columns: np.ndarray, height: int, width: int) -> np.ndarray:
    """How often each row number stands within ``REACH`` of each column number; -1 counts as neither."""
    cells = np.zeros(height * width, dtype=np.int64)
    for d in range(1, REACH + 1):
        for a, b in ((rows[:-d], columns[d:]), (rows[d:], columns[:-d])):
            both = (a >= 0) & (b >= 0)
            cells += np.bincount(a[both] * width + b[both], minlength=len(cells))
    return cells


def _meetings(heads: int):
    """How often heads stand near each other: ``k = head * heads + head``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(heads * heads, dtype=np.int64)
        for ids, _ in _stretches(batches):
            numbers = np.where((ids >= 0) & (ids < heads), ids, -1).astype(np.int64)
            cells += _pairs(numbers, numbers, heads, heads)
        at = np.flatnonzero(cells)
        yield pa.record_batch([pa.array(at), pa.array(cells[at])], names=["k", "n"])

    return run


def _company(heads: int, frequent: int, group: np.ndarray, groups: int):
    """For each token that is no head (``id``, or ``word`` where it has no number): its count and that of each group near it."""

    def rows(ids, words, counts, cells) -> pa.RecordBatch:
        columns = [ids, words, pa.array(counts), *map(pa.array, np.ascontiguousarray(cells.T))]
        return pa.record_batch(columns, names=["id", "word", "n", *_group_columns(groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = max(frequent - heads, 0)
        known, seen = np.zeros((named, groups), dtype=np.int64), np.zeros(named, dtype=np.int64)
        of_head = np.full(max(frequent, heads) + 1, -1, dtype=np.int64)
        of_head[:len(group)] = group
        for ids, words in _stretches(batches):
            numbers = np.where(ids >= heads, ids - heads, np.where((ids < 0) & (ids != _GAP), named - 1 - ids.astype(np.int64), -1))
            near = np.where(ids >= 0, of_head[np.maximum(ids, -1)], -1)
            height = named + len(words)
            if not height:
                continue
            cells = _pairs(numbers, near, height, groups).reshape(height, groups)
            counts = np.bincount(numbers[numbers >= 0], minlength=height)
            known += cells[:named]
            seen += counts[:named]
            for i in range(0, len(words), _OUT_ROWS):
                part = slice(named + i, min(named + i + _OUT_ROWS, height))
                some = words.slice(i, _OUT_ROWS)
                yield rows(pa.nulls(len(some), pa.int64()), some, counts[part], cells[part])
        at = np.flatnonzero(seen)
        yield rows(pa.array(at), pa.nulls(len(at), pa.binary()), seen[at], known[at])

    return run


def _group_columns(groups: int) -> list[str]:
    return [f"c{g}" for g in range(groups)]


def _classes(likely: np.ndarray, heads: int):
    """(id, word, n, class) of tokens with the counts of their company: the group whose company makes theirs most likely."""
    groups = len(likely)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            company = np.stack([b.column(3 + g).to_numpy() for g in range(groups)], axis=1) if b.num_rows else np.zeros((0, groups))
            best = best_groups(company, b.column(2).to_numpy(), likely)
            yield pa.record_batch([*b.columns[:3], pa.array((heads + best).astype(np.int32))], names=["id", "word", "n", "class"])

    return run


def best_groups(company: np.ndarray, counts: np.ndarray, likely: np.ndarray) -> np.ndarray:
    """Group of each token; the number of groups stands for tokens that are rare or keep no company."""
    known = (company.sum(axis=1) > 0) & (counts >= SEEN)
    return np.where(known, (company @ likely.T).argmax(axis=1), len(likely))


def head_groups(meetings: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Group of each head: the two groups whose union tells least less about their neighbours are merged until few are left."""
    p = (meetings + 1e-9) / (meetings.sum() + 1e-9 * meetings.size)

    def known(x: np.ndarray) -> np.ndarray:
        return (x * np.log(x / x.sum(axis=-1, keepdims=True))).sum(axis=-1)

    def loss(one: np.ndarray, others: np.ndarray) -> np.ndarray:
        return known(one) + known(others) - known(one + others)

    group, gone = np.arange(len(p)), np.zeros(len(p), dtype=bool)
    losses = np.stack([loss(row, p) for row in p])
    losses[~np.triu(np.ones_like(losses, dtype=bool), 1)] = np.inf
    for _ in range(len(p) - groups):
        i, j = np.unravel_index(losses.argmin(), losses.shape)
        p[i] += p[j]
        gone[j] = True
        group[group == j] = i
        losses[j] = losses[:, j] = np.inf
        fresh = np.where(gone, np.inf, loss(p[i], p))
        losses[i, i + 1:], losses[:i, i] = fresh[i + 1:], fresh[:i]
    return np.unique(group, return_inverse=True)[1]


def token_classes(numbers: DataFrame, heads: int, groups: int, counts: np.ndarray) -> tuple[np.ndarray, DataFrame]:
    """Class of each frequent token, and the table (word, n, class) of all other tokens in ``numbers`` (ids, words).

    Heads are classes 0 to ``heads`` - 1, groups follow, and ``heads + groups`` is the class of rare tokens.
    """
    met = numbers.mapInArrow(_meetings(heads), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    meetings = np.zeros((heads, heads))
    meetings.ravel()[met.column("k").to_numpy()] = met.column("n").to_numpy()
    group = head_groups(meetings, groups)
    member = np.eye(groups)[group]
    company = member.T @ meetings @ member + 0.5
    likely = np.log(company / company.sum(axis=1, keepdims=True))
    cells = _group_columns(groups)
    # Classes follow from the sums at once, so that the company of all tokens is not kept beside them.
    kept = written(
        numbers.mapInArrow(_company(heads, len(counts), group, groups), "id bigint, word binary, n bigint" + "".join(f", {c} bigint" for c in cells))
        .groupBy("id", "word").agg(*[F.sum(c).alias(c) for c in ["n", *cells]])
        .mapInArrow(_classes(likely, heads), "id bigint, word binary, n bigint, class int"), "others")
    labels = np.arange(len(counts))
    labels[heads:] = heads + groups
    # At most one row for each frequent token.
    named = kept.where("id IS NOT NULL").select("id", "class").toArrow()
    labels[heads + named.column("id").to_numpy()] = named.column("class").to_numpy()
    return labels, kept.where("word IS NOT NULL").select("word", "n", "class")


def classed(texts: DataFrame, others: DataFrame) -> DataFrame:
    """Coded texts with what ``others`` says of the tokens without a number: ``at`` (place in ``words``), ``n``, ``class``."""
    named = texts.select("key", F.posexplode("words").alias("at", "word")).join(others, "word")
    lists = named.groupBy("key").agg(F.collect_list(F.struct("at", "n", "class")).alias("o"))
    return written(
        texts.select("key", "doc", "held_out", "ids", F.size("words").alias("n_words")).join(lists, "key", "left")
        .select("doc", "held_out", "ids", "n_words", *[F.coalesce(F.col("o")[c], F.array()).cast(f"array<{t}>").alias(c) for c, t in (("at", "int"), ("n", "bigint"), ("class", "int"))]),
        "classed")


def _tokens_of(batch: pa.RecordBatch, rare: int, at_once: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of texts (ids, n_words, at, n, class), some at a time, their numbers, the counts and classes that ``-1 - number`` points to, and where each begins."""
    lists = []
    for name in ("at", "n", "class"):
        column = batch.column(batch.schema.get_field_index(name))
        lists.append((column.offsets.to_numpy(), column.values.to_numpy()))
    sizes = batch.column(batch.schema.get_field_index("n_words")).to_numpy()
    held, first, size = [], 0, 0
    for i, ids in enumerate(_numbers(batch.column(batch.schema.get_field_index("ids"))), 1):
        held.append(ids)
        size += len(ids)
        if size < at_once and i < batch.num_rows:
            continue
        lengths, words = np.array([len(x) for x in held]), sizes[first:i].astype(np.int64)
        base = np.cumsum(words) - words
        whole = np.concatenate(held).astype(np.int64)
        whole = np.where(whole < 0, whole - np.repeat(base, lengths), whole)
        at, n, c = (values[offsets[first]:offsets[i]] for offsets, values in lists)
        at = at + np.repeat(base, np.diff(lists[0][0][first:i + 1]))
        counts, classes = np.zeros(words.sum(), dtype=np.int64), np.full(words.sum(), rare, dtype=np.int64)
        counts[at], classes[at] = n, c
        yield whole, counts, classes, np.cumsum(lengths) - lengths
        held, first, size = [], i, 0


def _looked_up(ids: np.ndarray, of_number: np.ndarray, of_other: np.ndarray) -> np.ndarray:
    if not len(of_number):
        return of_other[-1 - ids]
    out, at = of_number[np.maximum(ids, 0)], np.flatnonzero(ids < 0)
    out[at] = of_other[-1 - ids[at]]
    return out


def _before(classes: np.ndarray, starts: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two before each token; texts begin at ``starts`` and are preceded by the class ``start``."""
    one, two = np.full(len(classes), start), np.full(len(classes), start)
    one[1:], two[2:] = classes[:-1], classes[:-2]
    one[starts] = two[starts] = start
    two[starts[starts + 1 < len(two)] + 1] = start
    return one, two


def _trigrams(labels: np.ndarray, rare: int):
    """Counts of (class two before, class one before, class) as one number."""
    start, size = rare + 1, rare + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for ids, _, classes, starts in _tokens_of(batch, rare):
                c = _looked_up(ids, labels, classes)
                one, two = _before(c, starts, start)
                keys.append((two * size + one) * size + c)
            if keys:
                k, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.record_batch([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    return run


def start_weights(rare: int, unigram: np.ndarray, dim: int = DIM) -> np.ndarray:
    rng = np.random.default_rng(11)
    v = rare + 1
    return np.concatenate([
        rng.normal(0, 0.1, (v + 1) * dim), np.ones(2 * dim), rng.normal(0, 0.1, v * dim), np.log(unigram)]).astype(np.float64)


def parts(theta: np.ndarray, v: int, dim: int = DIM) -> tuple[np.ndarray, ...]:
    """Views of (context vectors, weights of the word before, of the one before that, output vectors, biases)."""
    a = (v + 1) * dim
    b = a + 2 * dim
    return theta[:a].reshape(v + 1, dim), theta[a:a + dim], theta[a + dim:b], theta[b:b + v * dim].reshape(v, dim), theta[b + v * dim:]


def _added(places: np.ndarray, rows: np.ndarray, height: int) -> np.ndarray:
    """Rows summed by place."""
    return np.stack([np.bincount(places, column, height) for column in np.ascontiguousarray(rows.T)], axis=1)


def nce_steps(theta: np.ndarray, keys: np.ndarray, n: np.ndarray, unigram: np.ndarray, steps: int, rate: float, seed: int) -> np.ndarray:
    """Steps of Adam on the noise-contrastive loss over trigrams drawn by their counts; noise is shared in a batch.

    What comes back is the mean of the weights over the second half of the steps.
    """
    v, size = len(unigram), len(unigram) + 1
    rng = np.random.default_rng(seed)
    edges, noise_edges = np.cumsum(n), np.cumsum(unigram)
    theta, late = theta.copy(), np.zeros_like(theta)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    offset = np.log(NOISE * unigram)
    dim = parts(theta, v)[1].shape[0]
    # Single precision is enough for the products with noise; weights and their moments are double. The last column of both
    # factors carries the biases. A logistic function is (1 + tanh(x / 2)) / 2, so that one pass over the products is enough.
    turned = np.empty((_BLOCK, NOISE), dtype=np.float32)
    pulled = np.empty((BATCH // _BLOCK, _BLOCK, dim), dtype=np.float32)
    blocks = np.ones((BATCH // _BLOCK, _BLOCK, dim + 1), dtype=np.float32)
    flat = blocks.reshape(BATCH, dim + 1)
    against = np.empty((NOISE, dim + 1), dtype=np.float32)
    centre, g = np.zeros_like(theta), np.empty_like(theta)
    parts(centre, v)[4][:] = np.log(unigram)
    r, c1, c2, q, b = parts(theta, v)
    gr, g1, g2, gq, gb = parts(g, v)
    for i in range(1, steps + 1):
        if (i - 1) % _DRAWN == 0:
            # Drawn in order (sums of exponential gaps), which needs no sort and keeps the search in the cache, and dealt to the steps.
            at = np.cumsum(rng.standard_exponential(min(_DRAWN, steps + 1 - i) * BATCH + 1))
            at = np.searchsorted(edges, at[:-1] * (edges[-1] / at[-1]), side="right")
            drawn = rng.permutation(keys[np.minimum(at, len(keys) - 1)].reshape(BATCH, -1).T)
        k = drawn[(i - 1) % _DRAWN]
        context, w = np.divmod(k, size)
        two, one = np.divmod(context, size)
        noise = np.minimum(np.searchsorted(noise_edges, rng.random(NOISE) * noise_edges[-1], side="right"), v - 1)
        flat[:, :dim] = h = (r * c1).take(one, axis=0) + (r * c2).take(two, axis=0)
        qw = q.take(w, axis=0)
        real = 1 / (1 + np.exp(-np.clip(np.einsum("ij,ij->i", h, qw) + (b - offset)[w], -30, 30))) - 1
        against[:, :dim], against[:, dim] = q[noise], (b - offset)[noise]
        halves, vectors = against.T * np.float32(0.5), np.ascontiguousarray(against[:, :dim])
        of_noise = np.r_[h.sum(axis=0), BATCH]
        for block, out in zip(blocks, pulled):
            np.tanh(np.matmul(block, halves, out=turned), out=turned)
            np.matmul(turned, vectors, out=out)
            of_noise = of_noise + turned.T @ block
        of_noise *= 0.5
        dh = real[:, None] * qw + 0.5 * (pulled.reshape(h.shape) + vectors.sum(axis=0))
        after_one, after_two = _added(one, dh, v + 1), _added(two, dh, v + 1)
        gr[:] = after_one * c1 + after_two * c2
        g1[:], g2[:] = (after_one * r).sum(axis=0), (after_two * r).sum(axis=0)
        gq[:] = _added(w, real[:, None] * h, v) + _added(noise, of_noise[:, :dim], v)
        gb[:] = np.bincount(w, real, v) + np.bincount(noise, of_noise[:, dim], v)
        step = g / BATCH + PULL / edges[-1] * (theta - centre)
        m, s = 0.9 * m + 0.1 * step, 0.99 * s + 0.01 * step * step
        theta -= rate * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-8)
        if 2 * i > steps:
            late += theta
    return late / (steps - steps // 2)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (share, k, n) sorted by share to one row for each share, however many a task holds."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        keys, n = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (1, 2))
        order = np.argsort(keys, kind="stable")
        return pa.record_batch([pa.array([keys[order].tobytes()], pa.binary()), pa.array([n[order].tobytes()], pa.binary())], names=["k", "n"])

    for batch in batches:
        number = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]).tolist() if len(number) else []
        for a, b in zip(starts, [*starts[1:], len(number)]):
            if held and held[0].column(0)[0].as_py() != number[a]:
                yield out()
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield out()


def _round(theta: np.ndarray, unigram: np.ndarray, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                keys, n = np.frombuffer(k.as_buffer(), dtype=np.int64), np.frombuffer(c.as_buffer(), dtype=np.int64)
                weight = float(n.sum())
                steps = max(STEPS, int(np.ceil(PASSES * weight / (ROUNDS * BATCH))))
                new = nce_steps(theta, keys, n, unigram, steps, RATE / (1 + number), int(keys[0] + 7919 * number))
                yield pa.record_batch([pa.array(np.arange(len(new))), pa.array(new * weight), pa.array(np.full(len(new), weight))], names=["i", "v", "w"])

    return run


def shares(grams: DataFrame, total: int) -> DataFrame:
    """Trigram counts (share, k, n), dealt by hash to as many shares as the tokens ask for, whatever the partitions; sorted by share in each.

    A trigram that alone fills a share is dealt to several.
    """
    share = share_tokens(total)
    number = max(1, total // share)
    pieces = F.floor(F.col("n") / share).cast("int") + 1
    cut = grams.select("k", "n", pieces.alias("p")).select("k", "n", "p", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("i"))
    part = F.floor((F.col("i") + 1) * F.col("n") / F.col("p")) - F.floor(F.col("i") * F.col("n") / F.col("p"))
    return cut.select("k", part.cast("long").alias("n"), "i").where("n > 0").select(
        F.pmod(F.xxhash64("k", "i"), F.lit(number)).alias("share"), "k", "n").repartition(number, "share").sortWithinPartitions("share")


def score_tables(theta: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the next class by the word before, and by the one before that with the bias in it."""
    r, c1, c2, q, b = parts(theta, v)
    return (r * c1) @ q.T, (r * c2) @ q.T + b


def context_norms(near: np.ndarray, far: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """Log of the sum over all classes for each context whose second word before is in ``twos``."""
    norm = np.empty((len(twos), len(near)))
    for i, two in enumerate(twos):
        s = near + far[two]
        top = s.max(axis=1)
        norm[i] = top + np.log(np.exp(s - top[:, None]).sum(axis=1))
    return norm


def normalised(spark, theta: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both score tables and the log of each context's sum, which tasks work out by batched matrix products.

    Classes that are not ``used`` have probability 0.
    """
    v = len(used)
    near, far = score_tables(theta, v)
    far[:, ~used] = -np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            twos = batch.column(0).to_numpy()
            if len(twos):
                yield pa.record_batch([pa.array(twos), pa.array([r.tobytes() for r in context_norms(near, far, twos)], pa.binary())], names=["two", "norm"])

    got = spark.range(0, v + 1, 1, max(1, (v + 1) // 64)).mapInArrow(run, "two bigint, norm binary").toArrow()
    norm = np.empty((v + 1, v + 1))
    for two, row in zip(got.column("two").to_pylist(), got.column("norm").to_pylist()):
        norm[two] = np.frombuffer(row)
    return near, far, norm


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of all of ``docs`` as a written table."""
    texts = docs.select(F.col(text_col).alias("t"))
    return written(texts.mapInArrow(_counted, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def most_frequent(counts: DataFrame) -> list:
    return counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()


def numbered(spark, words: list[bytes]):
    """Broadcast numbers of the frequent tokens."""
    return spark.sparkContext.broadcast({w: i for i, w in enumerate(words)})


def fit(texts: DataFrame, counts: DataFrame, top: list) -> tuple[Model, DataFrame, DataFrame]:
    """The model of those coded ``texts`` that are not held out, given their token counts; (word, n, class) of the tokens
    without a number; and all ``texts`` with these."""
    spark = texts.sparkSession
    stats = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, words = int(stats["n"]), [bytes(r["word"]) for r in top]
    kept = np.array([r["n"] for r in top], dtype=np.float64)
    heads, groups = class_numbers(total)
    heads = min(heads, len(top))
    groups = min(groups, heads)
    rare = heads + groups
    if not heads:
        labels, others = np.zeros(0, dtype=np.int64), spark.createDataFrame([], "word binary, n bigint, class int")
    else:
        labels, others = token_classes(texts.where("NOT held_out").select("ids", "words"), heads, groups, kept)
    mass, size = np.bincount(labels, kept, rare + 1), np.bincount(labels, minlength=rare + 1)
    for r in others.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[r["class"]] += r["n"]
        size[r["class"]] += r["v"]
    # One token for what was never seen.
    size[rare] += 1
    whole = mass + 0.5 * size
    # In training a class without tokens counts as half a token, so that logarithms exist.
    unigram = np.maximum(whole, 0.5) / np.maximum(whole, 0.5).sum()
    theta = start_weights(rare, unigram)
    ready = classed(texts, others)
    if total:
        grams = written(
            ready.where("NOT held_out").select("ids", "n_words", "at", "n", "class").mapInArrow(_trigrams(labels, rare), "k bigint, n bigint")
            .groupBy("k").agg(F.sum("n").alias("n")), "trigrams")
        # Dealt once: every round reads the same shares, each a row.
        dealt = written(shares(grams, total).mapInArrow(_packed, "k binary, n binary"), "shares")
        for number in range(ROUNDS):
            mean = dealt.mapInArrow(_round(theta, unigram, number), "i bigint, v double, w double").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
            theta = np.array([r["v"] for r in sorted(mean.collect(), key=lambda r: r["i"])])
    return Model(words, kept, labels, whole, total, int(stats["v"]), *normalised(spark, theta, size > 0)), others, ready


def learn(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all of ``docs``, and the table (word, n, class) of the tokens that the model does not hold itself.

    Null texts count as empty. Without documents every count is 0 and every class equally likely.
    """
    counts = token_counts(docs, text_col)
    top = most_frequent(counts)
    shared = numbered(docs.sparkSession, [bytes(r["word"]) for r in top])
    texts = coded(docs.select(F.lit(0).alias("_i"), F.col(text_col).alias("_t")), shared, F.lit(False), "_i", "_t")
    model, others, _ = fit(texts, counts, top)
    return model, others


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        whole = np.log10(np.where(model.whole > 0, model.whole, 1))
        logs = np.log10(model.counts + 0.5)
        for batch in batches:
            sums = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))]
            for ids, counts, classes, starts in _tokens_of(batch, model.rare):
                at = _looked_up(ids, model.labels, classes)
                seen = _looked_up(ids, logs, np.log10(counts + 0.5))
                known = (_looked_up(ids, model.counts, counts) > 0).astype(np.int64)
                found = model.class_log10(at, starts) + seen - whole[at]
                sums.append((np.diff(np.r_[starts, len(ids)]), *(np.add.reduceat(x, starts) for x in (known, seen, found))))
            columns = [pa.array(np.concatenate(c)) for c in zip(*sums)]
            yield pa.record_batch([*batch.columns[:2], *columns], names=["doc_id", "held_out", "n_tokens", "n_known", "logs", "score"])

    return run


def score(docs: DataFrame, model: Model, others: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    Null and empty texts are the end alone. Repeated rows each get their own equal result. Scores are sums of log10
    probabilities over all tokens of the whole text.
    """
    return score_classed(classed(coded(docs, numbered(docs.sparkSession, model.words), held_out, id_col, text_col), others), model)


def score_classed(texts: DataFrame, model: Model) -> DataFrame:
    """What ``score`` returns, of texts whose tokens all have their counts and classes."""
    shared = texts.sparkSession.sparkContext.broadcast(model)
    per_token = float(np.log10(model.total + 0.5 * (model.distinct + 1)))
    return texts.mapInArrow(
        _scored(shared), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, score double",
    ).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * per_token).alias("base_score"), "score")


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_fold: int = 1, folds: int = 5) -> DataFrame:
    held = fold(id_col, folds) == held_fold
    counts = token_counts(docs.where(~held), text_col)
    top = most_frequent(counts)
    # Texts are cut into tokens twice: to count them, and to number them for all that follows.
    model, _, texts = fit(coded(docs, numbered(docs.sparkSession, [bytes(r["word"]) for r in top]), held, id_col, text_col), counts, top)
    return score_classed(texts, model)
