"""Mixing to target weights: token weights of cells raked to source, language and topic marginals, then sampling.

Only the table of cells (source x language x topic) reaches the driver; its size is checked. Documents are read once for
the cell sums and once to be sampled, with no shuffle of texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.llm.common import packed

MARGINS = ("source", "lang", "topic")
SWEEPS = 20
#: More cells than this are an error: marginals are meant to be short lists.
MAX_CELLS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """What a text mostly is, by its form: the default third marginal."""
    return (
        F.when(text.rlike(r"[A-Za-z0-9]@[A-Za-z0-9]|\+[0-9]"), "contact").when(text.rlike("(?i)licen[sc]e"), "licence")
        .when(F.contains(text, F.lit("|")), "table").when(F.char_length(text) < 400, "short").otherwise("prose"))


def _described(docs: DataFrame, id_col: str, text_col: str, topic_of) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = {m: F.coalesce(F.col(m).cast("string"), F.lit("unknown")) for m in MARGINS[:2]}
    return packed(
        docs, _source=named["source"], _lang=named["lang"], _topic=topic_of(text), _tokens=F.regexp_count(text, F.lit(WORD)).cast("long"),
        _key=F.coalesce(F.col(id_col).cast("string"), F.md5(text)))


def rake(cells: list[tuple], targets: dict[str, dict] | None = None, power: float = 0.5, sweeps: int = SWEEPS) -> list[float]:
    """Weights of the cells (source, lang, topic, tokens): the token shares scaled, one marginal after the other.

    A marginal without a target aims at its token shares to the ``power``, which lifts small parts. Target names that
    no cell has are left out and the rest scaled to 1; names without a target get 0. Zero-token cells have weight 0.
    """
    tokens = np.array([c[3] for c in cells], dtype=np.float64)
    if not tokens.sum():
        return [0.0] * len(cells)
    w = tokens / tokens.sum()
    codes, wanted = [], []
    for i, margin in enumerate(MARGINS):
        names = sorted({c[i] for c in cells})
        at = np.array([names.index(c[i]) for c in cells])
        share = np.bincount(at, tokens, len(names))
        aim = share**power * (share > 0) if not (targets or {}).get(margin) else np.array([float(targets[margin].get(n, 0.0)) for n in names]) * (share > 0)
        if not aim.sum():
            raise ValueError(f"no target of {margin} occurs in the data")
        codes.append(at)
        wanted.append(aim / aim.sum())
    for _ in range(sweeps):
        for at, aim in zip(codes, wanted):
            now = np.bincount(at, w, len(aim))
            w = w * np.divide(aim, now, out=np.zeros_like(aim), where=now > 0)[at]
    return w.tolist()


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, id_col: str = "doc_id", text_col: str = "text", topic_of=topic,
        power: float = 0.5, seed: int = 7, sweeps: int = SWEEPS) -> DataFrame:
    """``docs`` with _source, _lang, _topic, _tokens, _weight (of a token of the cell against the average token),
    _probability, _repeat and _kept.

    A weight below 1 is the probability of being kept; from 1 on a document always stays, and _repeat says how often to
    show it. Probability times repeat is the weight, so expected tokens follow the raked weights exactly. A document's chance is a hash of seed and id, so a rerun keeps the same ones and repeated rows share
    their fate; a null id is replaced by the text. Null sources and languages are "unknown", null texts empty. Documents
    without tokens stay only if their cell has tokens and the draw keeps them. An empty table gives an empty one. Columns
    with these names are replaced.
    """
    described = _described(docs, id_col, text_col, topic_of)
    sums = described.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("_n")).limit(MAX_CELLS + 1).collect()
    if len(sums) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; give coarser marginals")
    cells = sorted((r["_source"], r["_lang"], r["_topic"], r["_n"]) for r in sums)
    total = sum(c[3] for c in cells)
    weights = [w * total / c[3] if c[3] else 0.0 for w, c in zip(rake(cells, targets, power, sweeps), cells)]
    table = docs.sparkSession.createDataFrame(
        [(*c[:3], w, min(1.0, w), max(1.0, w)) for c, w in zip(cells, weights)],
        "_s string, _l string, _t string, _weight double, _probability double, _repeat double")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_key"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    same = (F.col("_source") == F.col("_s")) & (F.col("_lang") == F.col("_l")) & (F.col("_topic") == F.col("_t"))
    added = ["_source", "_lang", "_topic", "_tokens", "_weight", "_probability", "_repeat"]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in {*added, "_kept"}]
    return described.join(F.broadcast(table), same).select(*own, *added, (draw < F.col("_probability")).alias("_kept"))
