"""Benchmark passages in documents: item word windows as a broadcast hash set, looked up at every document position.

DataFrame functions only. A document's words stay in its row: each position yields a hash of the next words inside
generated code, and only positions whose hash and then whose words match a window go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.llm.common import lower_ascii, packed, text_key, unpacked

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Up to so many distinct item windows (of ``n`` words each) are broadcast; more are joined with a shuffle.
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _key(size: int, at: Column) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col("_w"), at + k) for k in range(size)])


def item_windows(items: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows: (size, gram: words, items: ids as sorted text). A shorter item is one window; no words: none."""
    listed = items.select(F.col(id_col).cast("string").alias("_i"), words(F.col(text_col)).alias("_w")).where(F.size("_w") > 0)
    grams = F.when(F.size("_w") <= n, F.array(F.col("_w"))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (n - 1), F.lit(1))), lambda i: F.slice(F.col("_w"), i, n)))
    return (
        listed.select("_i", F.explode(grams).alias("gram"))
        .groupBy("gram").agg(F.array_sort(F.collect_set("_i")).alias("items"))
        .select(F.size("gram").alias("size"), "gram", "items"))


def hits(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document with a hit: (_id, _h, spans: array of (start, end) in words, not merged, items: sorted ids)."""
    windows = item_windows(items, n, item_id, item_text)
    sizes = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}
    split = docs.select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_h"), words(F.col(text_col)).alias("_w"))
    if not sizes:
        none = "array<struct<start:int,end:int>>"
        return split.select("_id", "_h", F.lit(None).cast(none).alias("spans"), F.lit(None).cast("array<string>").alias("items")).where("false")
    # A null array gives no places; a filter on the words would make Spark find them twice.
    room = F.size("_w") - min(sizes)
    places = split.select("_id", "_h", "_w", F.explode(F.when(room >= 0, F.sequence(F.lit(0), room))).alias("_at"))
    if len(sizes) == 1:
        size = next(iter(sizes))
        places = places.select("*", F.lit(size).alias("_n"), _key(size, F.col("_at")).alias("_k"))
    else:
        each = F.array(*[F.struct(F.lit(s).alias("_n"), _key(s, F.col("_at")).alias("_k")) for s in sorted(sizes)])
        places = places.select("*", F.inline(each)).where(F.col("_at") + F.col("_n") <= F.size("_w"))
    keys = F.coalesce(*[F.when(F.col("size") == s, F.xxhash64(F.lit(s), *[F.get(F.col("gram"), F.lit(k)) for k in range(s)])) for s in sorted(sizes)])
    table = windows.select(keys.alias("_k"), "size", "gram", "items")
    if sum(sizes.values()) <= BROADCAST_WINDOWS:
        # Not written as an equality, which would become a join key and be hashed at every place.
        same = (F.col("_k") == F.col("_tk")) & F.array_contains(F.array("gram"), F.slice(F.col("_w"), F.col("_at") + 1, F.col("_n")))
        met = places.join(F.broadcast(table.withColumnRenamed("_k", "_tk")), same)
    else:
        met = places.select("_id", "_h", "_at", "_n", "_k", F.slice(F.col("_w"), F.col("_at") + 1, F.col("_n")).alias("gram")).join(
            table, ["_k", "gram"])
    return met.groupBy("_id", "_h").agg(
        F.collect_set(F.struct(F.col("_at").alias("start"), (F.col("_at") + F.col("_n")).alias("end"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(spans: Column) -> Column:
    """Number of words inside any span."""
    start = F.struct(F.lit(0).alias("e"), F.lit(0).alias("t"))
    return F.aggregate(
        F.array_sort(spans), start,
        lambda a, s: F.struct(
            F.greatest(a["e"], s["end"]).alias("e"),
            (a["t"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["e"], s["start"]))).alias("t")))["t"]


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, n_words, n_hit, items, spans).

    Null and empty texts have no words and no hits; so have all when there are no items. Rows that repeat id and text
    each get the same result, rows that share only the id get their own. Items may repeat; each id counts once.
    """
    found = hits(docs, items, n, id_col, text_col).select(
        F.col("_id").alias("_hid"), F.col("_h").alias("_hh"), "spans", "items", _covered(F.col("spans")).alias("_c"))
    base = docs.select(
        F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("_h"), F.size(words(F.col(text_col))).cast("long").alias("n_words"))
    return base.join(found, F.col("doc_id").eqNullSafe(F.col("_hid")) & (F.col("_h") == F.col("_hh")), "left").select(
        "doc_id", "n_words", F.coalesce("_c", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", n: int = 10, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated documents, or (``remove="spans"``) without the hit words in their texts.

    Null and empty texts have no words and stay as they are, null ids too; repeated rows share their fate. Long texts are
    scanned whole. An empty table gives an empty one, and without items all rows stay. Further columns may have any name.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    found = hits(docs, items, n, id_col, text_col).select(F.col("_id").alias("_hid"), F.col("_h").alias("_hh"), F.col("spans").alias("_spans"))
    rows = packed(docs, id=F.col(id_col), h=text_key(F.col(text_col)), text=F.col(text_col))
    same = F.col("id").eqNullSafe(F.col("_hid")) & (F.col("h") == F.col("_hh"))
    if remove == "documents":
        return unpacked(rows.drop("text").join(found, same, "left_anti"), docs.columns)
    text = F.col("text")
    kept = F.transform(
        F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0)),
        lambda w, i: F.when(F.exists(F.col("_spans"), lambda s: (s["start"] <= i) & (i < s["end"])), F.lit("")).otherwise(w))
    pieces = F.split(text, RAW_WORD, -1)
    cut = F.concat_ws("", F.zip_with(pieces, kept, lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))))
    return unpacked(rows.join(found, same, "left"), docs.columns, **{text_col: F.when(F.col("_spans").isNull(), text).otherwise(cut)})
