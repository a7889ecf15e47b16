"""Toxic spans from a linear-chain conditional random field over words, and document scores from its marginals.

1. Cues. Words and word beginnings are counted in toxic and clean documents of the first part of a labelled sample, once for
   each pair of neighbouring words, so copies of a document count once. A cue's strength is the lower bound of its log odds.
2. Labelled tokens. In the second part of the sample, which the cues have not seen, a word of a toxic document is labelled
   toxic if its cue is strong or the strongest of its document; all words of clean documents are labelled clean.
3. Field. A sentence is a chain of words. A word is described by the strength class of its own cue and of its neighbours';
   the chain adds how labels follow each other. Refitting on its own marginals in toxic documents follows once.
4. Documents. The highest marginal, the sum of the marginals of cued words and the length are calibrated to a probability. Words with a
   marginal of one half or more are the offending spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from tablesmith.llm.common import fold, written
from tablesmith.llm.crf import _chain

#: The fit reads so many labelled rows of each label at most, those with the smallest hashed ids, and so many bytes of text.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 48 << 20
ACCEPT = 0.7
#: Lengths of word beginnings, distinct neighbourhoods that a cue needs, and the lower ends of the strength classes.
STEMS, SEEN = range(3, 10), 4
EDGES = np.array([0.0, 0.75, 1.5, 2.25, 3.0, 4.0, 5.0])
CLASSES = len(EDGES) + 1
_STRONG = 4
#: Longer sentences are cut into chains of so many words.
_LONGEST = 64
_END = 255
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_STEP_CHARS = 1 << 20


def _cues(word: str) -> list[str]:
    """A word and its beginnings; words in full have a mark so that they differ from beginnings."""
    w = word.lower()
    return [f"={w[:64]}", *[w[:n] for n in STEMS if n <= len(w)]]


def _cue_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(toxic, text) to distinct (toxic, cue, neighbourhood)."""
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = [w.lower() for w in _TOKEN.findall(text or "")]
            around = ["", *words, ""]
            found = {(cue, f"{around[i]} {around[i + 2]}") for i, w in enumerate(words) if w[0].isalpha() for cue in _cues(w)}
            if found:
                cues, near = zip(*found)
                yield pa.record_batch([pa.array([toxic] * len(found), pa.int32()), pa.array(cues), pa.array(near)], names=["toxic", "cue", "near"])


@dataclass
class SpanField:
    """A fitted field; of bounded size, small enough to travel with the task."""

    cues: dict[str, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * CLASSES))
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def __post_init__(self) -> None:
        self.known: dict[str, int] = {}
        self.plain: tuple[np.ndarray, np.ndarray] | None = None

    def strength(self, word: str) -> int:
        """Strength class of a word's strongest cue, 0 for none."""
        got = self.known.get(word)
        if got is None:
            got = _END if word in ".!?\n" else max(self.cues.get(c, 0) for c in _cues(word))
            if len(word) <= 64:
                if len(self.known) > 500_000:
                    self.known.clear()
                self.known[word] = got
        return got

    def codes(self, text: str) -> np.ndarray:
        """Strength class of each word, ``_END`` for sentence ends."""
        words = _TOKEN.findall(text)
        known = self.known
        return np.array([known[w] if w in known else self.strength(w) for w in words], dtype=np.uint8)

    def unary(self, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Score of toxic over clean for words of chains laid end to end; ``first``: where chains begin."""
        before, after = np.zeros_like(own), np.zeros_like(own)
        before[1:], after[:-1] = own[:-1], own[1:]
        before[first] = 0
        after[np.r_[first[1:] - 1, len(own) - 1]] = 0
        w = self.weights.reshape(3, CLASSES)
        return w[0][own] + w[1][before] + w[2][after]

    def marginals(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probability of toxic for each word; ``counts``: words of each chain."""
        if not len(own):
            return np.zeros(0)
        return _chain(self.unary(own, np.cumsum(counts) - counts), counts, self.step)[0]

    def evidence(self, codes: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """(highest marginal's log odds, log of 1 + sum over cued words, log of 1 + words) of each text, and its words' marginals.

        Chains without any cue look alike but for their length, so those are worked out once.
        """
        if self.plain is None:
            one = [self.marginals(np.zeros(n, dtype=np.int64), np.array([n])) for n in range(1, _LONGEST + 1)]
            self.plain = np.array([0.0, *[p.max() for p in one]]), one
        own, counts, chain_text = chains(codes)
        first = np.cumsum(counts) - counts
        cued = np.add.reduceat(own > 0, first) > 0 if len(counts) else np.zeros(0, dtype=bool)
        live = np.repeat(cued, counts)
        p = np.zeros(len(own))
        p[live] = self.marginals(own[live], counts[cued])
        high = np.zeros(len(codes))
        np.maximum.at(high, chain_text, np.where(cued, np.maximum.reduceat(np.r_[p, 0.0], first) if len(counts) else 0.0, self.plain[0][counts]))
        word_text = np.repeat(chain_text, counts)
        total = np.bincount(word_text, weights=np.where(own > 0, p, 0.0), minlength=len(codes)) if len(own) else np.zeros(len(codes))
        high = np.clip(high, 1e-6, 1 - 1e-6)
        ends = np.cumsum(np.bincount(word_text, minlength=len(codes))) if len(own) else np.zeros(len(codes), dtype=int)
        words = np.diff(np.r_[0, ends])
        return np.column_stack([np.log(high / (1 - high)), np.log1p(total), np.log1p(words)]), np.split(p, ends[:-1]) if len(codes) else []

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[str]]:
        """Toxicity of each text, 0 to 1, and its offending spans as ``start:end`` in code points, joined by commas."""
        scores, spans, start = [], [], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or "") <= _STEP_CHARS):
                size += len(texts[end] or "")
                end += 1
            some = [t or "" for t in texts[start:end]]
            x, p = self.evidence([self.codes(t) for t in some])
            scores.append(1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.calibration, -30, 30))))
            for t, q in zip(some, p):
                if not (q >= 0.5).any():
                    spans.append("")
                    continue
                words = [m.span() for m in _TOKEN.finditer(t) if m.group() not in ".!?\n"]
                spans.append(",".join(f"{words[i][0]}:{words[i][1]}" for i in np.flatnonzero(q >= 0.5).tolist()))
            start = end
        return (np.concatenate(scores) if scores else np.zeros(0)), spans


def chains(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all words, words of each chain, text of each chain) from texts with sentence ends."""
    flat = np.concatenate(codes) if codes else np.zeros(0, dtype=np.uint8)
    text = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    is_word = flat != _END
    sentence = np.cumsum(~is_word)[is_word]
    text, own = text[is_word], flat[is_word].astype(np.int64)
    if not len(own):
        return own, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.r_[True, (text[1:] != text[:-1]) | (sentence[1:] != sentence[:-1])]
    begin = np.flatnonzero(new)
    place = np.arange(len(own)) - begin[np.cumsum(new) - 1]
    first = np.flatnonzero(place % _LONGEST == 0)
    return own, np.diff(np.r_[first, len(own)]), text[first]


def _fit_chain(model: SpanField, own: np.ndarray, counts: np.ndarray, y: np.ndarray, rounds: int = 120, decay: float = 1e-4) -> None:
    """Maximum likelihood of labelled words by full-batch Adam; every weight is a count of classes, so steps are cheap."""
    first = np.cumsum(counts) - counts
    last = np.r_[first[1:] - 1, len(own) - 1]
    before, after = np.r_[0, own[:-1]], np.r_[own[1:], 0]
    before[first], after[last] = 0, 0
    inner = np.ones(len(own), dtype=bool)
    inner[last] = False
    here = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[here].astype(int), y[here + 1].astype(int)), 1)
    n = 3 * CLASSES
    theta, m, v = np.r_[model.weights, model.step.ravel()], np.zeros(n + 4), np.zeros(n + 4)
    for i in range(1, rounds + 1):
        model.weights, model.step = theta[:n], theta[n:].reshape(2, 2)
        p, pairs = _chain(model.unary(own, first), counts, model.step)
        d = p - y
        g = np.concatenate([*[np.bincount(c, weights=d, minlength=CLASSES) for c in (own, before, after)], (pairs - seen).ravel()])
        g = g / max(y.sum(), 1.0) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.15 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    model.weights, model.step = theta[:n], theta[n:].reshape(2, 2)


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of labels on the evidence, slightly drawn to zero."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (weight * (p - y)) + 0.05 * w
        h = (a * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ a + 0.05 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic: str = "toxic",
          rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES, held_out: int = 1, folds: int = 3) -> SpanField | None:
    """Fit on labelled documents outside the held-out fold; None without documents of both labels.

    Up to ``rows`` ids of each label are taken, those with the smallest hashes, and of their texts, in that order, as many
    as fit into ``size`` bytes. Ids with both labels count as clean. Rows that repeat an id are taken once. Cues are
    counted in tasks; the driver gets cues and a byte per word of the bounded sample.
    """
    known = (
        labels.select(F.col(id_col).alias("_id"), F.col(toxic).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold("_id", folds) != held_out))
        .groupBy("_id").agg(F.min("_y").alias("_y")))
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return None
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("_y = 1").orderBy(*order).limit(rows).unionByName(known.where("_y = 0").orderBy(*order).limit(rows))
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t IS NOT NULL").join(F.broadcast(chosen), "_id")
    # One row per chosen id, so what follows is bounded by ``rows``.
    texts = written(texts.groupBy("_id", "_y").agg(F.min("_t").alias("_t")), "toxic-sample")
    running = Window.partitionBy("_y").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    fits = texts.select("_id", "_y", F.sum(F.octet_length("_t")).over(running).alias("_sum")).where(F.col("_sum") <= size // 2).select("_id")
    sample = texts.join(F.broadcast(fits), "_id").withColumn("_part", (F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(5)) < 3).cast("int"))
    seen = sample.where("_part = 1").select("_y", "_t").repartition("_t").mapInArrow(_cue_rows, "toxic int, cue string, near string").distinct()
    per = seen.groupBy("cue").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    docs_of = {r["_y"]: r["n"] for r in sample.where("_part = 1").groupBy("_y").agg(F.sum(F.octet_length("_t")).alias("n")).collect()}
    if len(docs_of) < 2:
        return None
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    odds = F.log(t / c) - F.log(F.lit(docs_of[1] / docs_of[0]))
    strong = per.where(f"t >= {SEEN}").select("cue", (odds - F.sqrt(1 / t + 1 / c)).alias("s")).where(F.col("s") > float(EDGES[0]))
    model = SpanField({r["cue"]: int(np.searchsorted(EDGES, r["s"], side="right")) for r in strong.collect()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, texts_ = batch.column(0), batch.column(1).to_pylist()
            yield pa.record_batch([y.cast(pa.int32()), pa.array([model.codes(x).tobytes() for x in texts_], pa.binary())], names=["y", "codes"])

    got = sample.where("_part = 0").select("_y", "_t").mapInArrow(describe, "y int, codes binary").toArrow()
    # Sums over rows in one order give the same model wherever the rows come from.
    rows_ = sorted(zip(got["y"].to_pylist(), got["codes"].to_pylist()))
    y = np.array([r[0] for r in rows_], dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    codes = [np.frombuffer(r[1], dtype=np.uint8) for r in rows_]
    own, counts, chain_text = chains(codes)
    if not len(own):
        return None
    word_text = np.repeat(chain_text, counts)
    top = np.zeros(len(codes), dtype=np.int64)
    np.maximum.at(top, word_text, own)
    is_toxic = y[word_text] > 0
    tag = is_toxic & (own > 0) & ((own >= _STRONG) | (own == top[word_text]))
    # Chains without cues in clean documents teach the same thing over and over: one of each document's lengths is enough.
    cued = np.add.reduceat(own > 0, np.cumsum(counts) - counts) > 0
    fresh = np.zeros(len(counts), dtype=bool)
    fresh[np.unique(np.stack([chain_text, counts]), axis=1, return_index=True)[1]] = True
    keep = cued | fresh
    live = np.repeat(keep, counts)
    for again in range(2):
        _fit_chain(model, own[live], counts[keep], tag[live].astype(np.float64))
        if not again:
            p = model.marginals(own[live], counts[keep])
            tag[live] = is_toxic[live] & (own[live] > 0) & (p >= 0.5)
            if not tag.any():
                break
    x, _ = model.evidence(codes)
    # Both labels weigh as in the whole training fold.
    weight = np.where(y > 0, share[1] / (share[0] + share[1]) / max((y > 0).mean(), 1e-9), share[0] / (share[0] + share[1]) / max((y == 0).mean(), 1e-9))
    model.calibration = _calibrated(x, y, weight)
    model.known, model.plain = {}, None
    return model


def toxicity(model: SpanField | None, text: Column) -> Column:
    """Struct of ``score`` and ``spans``. Null and empty texts have no words; without a model every score is 0.5."""
    if model is None:
        return F.struct(F.lit(0.5).alias("score"), F.lit("").alias("spans"))

    @arrow_udf("struct<score: double, spans: string>")
    def of(texts: pa.Array) -> pa.Array:
        scores, spans = model.score(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, pa.string())], names=["score", "spans"])

    return of(text)
