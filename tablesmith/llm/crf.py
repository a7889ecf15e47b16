"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line is described by its own form and by that of the lines before and after it; the chain
adds how likely labels follow each other. A line's forward-backward marginal is weighted by its length, and the mean is
a document's quality. Only documents are labelled, so a line is taught its document's label; a last calibration of two
numbers, fitted on the same rows, makes the mean a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from tablesmith.llm.common import fold

#: The fit reads so many labelled rows at most, those with the smallest hashed ids.
SAMPLE_ROWS = 6000
ACCEPT = 0.7
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b"*$#&%@^~=<>{}[]\\/_", b".,;:?'\"()-+"]
_CHUNK_BYTES = 4 << 20
OWN = 17
WIDTH = 3 * OWN


def _table() -> np.ndarray:
    lut = np.full(256, len(_CLASSES), dtype=np.uint8)
    for i, chars in enumerate(_CLASSES):
        lut[list(chars)] = i
    lut[128:] = len(_CLASSES) + 1
    return lut


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, weight of each line, number of lines of each text); no text: one empty line."""
    lines = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines])
    flat = [x for doc in lines for x in doc]
    joined = np.frombuffer(b"\n".join(flat) + b"\n", dtype=np.uint8)
    lengths = np.array([len(x) for x in flat])
    starts = np.r_[0, np.cumsum(lengths[:-1] + 1)]
    kinds = _table()[joined]
    share = np.stack([np.add.reduceat(kinds == i, starts, dtype=np.int64) for i in (0, 1, 2, 3, 4, 5, 7)], axis=1) / np.maximum(lengths, 1)[:, None]
    words = np.zeros((len(flat), 4))
    at = 0
    for doc in lines:
        seen: set[bytes] = set()
        whole: set[bytes] = set()
        for line in doc:
            parts = line.split()
            kept = set(parts)
            if parts:
                words[at] = len(parts), len(kept) / len(parts), len(kept & seen) / len(kept), line in whole
            seen |= kept
            whole.add(line)
            at += 1
    own = np.column_stack([
        np.ones(len(flat)), np.log1p(lengths) / 8, share, np.log1p(words[:, 0]) / 6,
        lengths / np.maximum(words[:, 0], 1) / 10, words[:, 1:4], share[:, 0] > 0.5, share[:, 2:5].max(axis=1) > 0.02])
    # 1 + 1 + 7 + 1 + 1 + 3 + 2, and whether the line is empty
    own = np.column_stack([own, lengths == 0]).astype(np.float32)
    first = np.cumsum(counts) - counts
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first] = 0
    after[first + counts - 1] = 0
    return np.hstack([own, before, after]), lengths + 1.0, counts


def _padded(counts: np.ndarray) -> list[np.ndarray]:
    """Groups of documents whose numbers of lines differ by less than a factor of two."""
    size = np.floor(np.log2(np.maximum(counts, 1))).astype(int)
    return [np.flatnonzero(size == s) for s in np.unique(size)]


def _chain(unary: np.ndarray, counts: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of "good" per line, and expected label pairs (2x2), for chains laid end to end.

    ``unary``: score of good over bad per line. Two states, so each message is one log-odds and no logarithm of sums
    over longer axes is needed.
    """
    first = np.cumsum(counts) - counts
    good = np.zeros(len(unary))
    pairs = np.zeros((2, 2))
    lse = np.logaddexp
    for group in _padded(counts):
        n, longest = counts[group], counts[group].max()
        places = first[group][:, None] + np.minimum(np.arange(longest), n[:, None] - 1)
        live = np.arange(longest) < n[:, None]
        u = np.where(live, unary[places], 0.0)
        fwd = np.zeros((longest, 2, len(group)))
        fwd[0, 1] = u[:, 0]
        for t in range(1, longest):
            b, g = fwd[t - 1]
            fwd[t, 0] = lse(b + step[0, 0], g + step[1, 0])
            fwd[t, 1] = lse(b + step[0, 1], g + step[1, 1]) + u[:, t]
        back = np.zeros((longest, 2, len(group)))
        for t in range(longest - 2, -1, -1):
            b, g = back[t + 1, 0], back[t + 1, 1] + u[:, t + 1]
            more = live[:, t + 1]
            back[t, 0] = np.where(more, lse(step[0, 0] + b, step[0, 1] + g), 0.0)
            back[t, 1] = np.where(more, lse(step[1, 0] + b, step[1, 1] + g), 0.0)
        both = fwd + back
        z = lse(both[0, 0], both[0, 1])
        p = np.exp(both[:, 1] - z).T
        good[places[live]] = p[live]
        if longest > 1:
            for y in range(2):
                for x in range(2):
                    s = fwd[:-1, y] + step[y, x] + back[1:, x] + (u[:, 1:].T if x else 0.0) - z
                    pairs[y, x] += np.exp(s)[live[:, 1:].T].sum()
    return good, pairs


@dataclass
class LineField:
    """A fitted field; small enough to travel with the task."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    step: np.ndarray
    calibration: tuple[float, float] = (1.0, 0.0)

    def raw(self, features: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        good, _ = _chain(((features - self.mean) / self.scale) @ self.weights, counts, self.step)
        first = np.cumsum(counts) - counts
        return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Quality of each text, 0 to 1."""
        out, start = [], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= _CHUNK_BYTES):
                size += len(texts[end])
                end += 1
            q = np.clip(self.raw(*line_features(texts[start:end])), 1e-9, 1 - 1e-9)
            a, b = self.calibration
            out.append(1 / (1 + np.exp(-np.clip(a * np.log(q / (1 - q)) + b, -30, 30))))
            start = end
        return np.concatenate(out) if out else np.zeros(0)


def fit_field(features: np.ndarray, weight: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 150, decay: float = 1e-4) -> LineField:
    """Maximum likelihood by full-batch Adam, each document with equal weight per line."""
    mean, scale = features.mean(axis=0), features.std(axis=0)
    mean[scale < 1e-6], scale[scale < 1e-6] = 0.0, 1.0
    x = ((features - mean) / scale).astype(np.float64)
    y = np.repeat(labels, counts).astype(np.float64)
    inner = np.ones(len(y), dtype=bool)
    inner[np.cumsum(counts) - 1] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner].astype(int), y[inner].astype(int)), 1)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for i in range(1, rounds + 1):
        good, pairs = _chain(x @ theta[:WIDTH], counts, theta[WIDTH:].reshape(2, 2))
        g = np.r_[x.T @ (good - y), (pairs - seen).ravel()] / len(y) + decay * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    field = LineField(mean.astype(np.float32), scale.astype(np.float32), theta[:WIDTH].astype(np.float32), theta[WIDTH:].reshape(2, 2))
    q = np.clip(field.raw(features, weight, counts), 1e-9, 1 - 1e-9)
    z = np.log(q / (1 - q))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d, h = p - labels, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-3]])
        change = np.linalg.solve(hess, [(d * z).sum() + 1e-3 * (a - 1), d.sum()])
        a, b = a - np.clip(change[0], -1, 1), b - np.clip(change[1], -1, 1)
    field.calibration = (max(float(a), 1e-3), float(b))
    return field


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality: str = "quality",
          rows: int = SAMPLE_ROWS, held_out: int = 2, folds: int = 4) -> LineField | None:
    """Fit on up to ``rows`` labelled documents outside the held-out fold; None without rows of both labels.

    Whole texts are described in tasks; the driver gets line features of the bounded sample only.
    """
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(quality).cast("int").alias("_q"))
        .where(F.col("_id").isNotNull() & F.col("_q").isin(0, 1) & (fold("_id", folds) != held_out))
        .groupBy("_id").agg(F.min("_q").alias("_q")).orderBy(F.xxhash64("_id"), "_id").limit(rows))

    def describe(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            for t, q in zip(texts, batch.column(0).to_pylist()):
                f, w, c = line_features([t])
                yield pa.record_batch([pa.array([q], pa.int32()), pa.array([f.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], names=["q", "f", "w"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(chosen), "_id").select("_q", "_t")
    got = texts.mapInArrow(describe, "q int, f binary, w binary").toArrow()
    y = np.array(got["q"].to_pylist(), dtype=np.float64)
    if len(set(y.tolist())) < 2:
        return None
    features = [np.frombuffer(f, dtype=np.float32).reshape(-1, WIDTH) for f in got["f"].to_pylist()]
    weight = np.concatenate([np.frombuffer(w) for w in got["w"].to_pylist()])
    # Sums over rows in one order give the same model wherever the rows come from.
    order = sorted(range(len(y)), key=lambda i: (y[i], features[i].tobytes()))
    counts = np.array([len(f) for f in features])
    first = np.cumsum(counts) - counts
    weight = np.concatenate([weight[first[i]:first[i] + counts[i]] for i in order])
    return fit_field(np.concatenate([features[i] for i in order]), weight, counts[order], y[order])


def quality(field: LineField | None, text: Column) -> Column:
    """Column of scores. Null and empty texts are one empty line; without a model every score is 0.5."""
    if field is None:
        return F.lit(0.5)

    @arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(field.score([t or b"" for t in texts.cast(pa.binary()).to_pylist()]), pa.float64())

    return of(text)


def keep_good(docs: DataFrame, field: LineField | None, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` without those scored below ``accept``; without a model all stay. Rows are judged one by one."""
    return docs if field is None else docs.where(quality(field, F.col(text_col)) >= accept)
