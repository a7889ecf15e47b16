"""Not-modified revisits of a crawl: each finds the latest earlier full response of its URL, as of its time.

DataFrame functions only. The as-of join is dealt by URL and time slot: a slot's last response comes from an aggregate,
the state before a slot from a window over a URL's slots, and only the order within a slot needs its rows together. A
URL with a large share of all captures is thus spread over its slots. Bodies never move: a result names the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fields of a 304 response that replace the stored ones.
UPDATES = ["cache-control", "content-location", "date", "etag", "expires", "vary"]
#: Query parameters that do not change what a URL names.
TRACKING = r"^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)"
SLOT_SECONDS = 3600


def canonical_url(url: Column) -> Column:
    """Lower-case host without www. and default port, no scheme, fragment, tracking parameters or closing slash;
    parameters in order."""
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_replace(bare, r"\?.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(place, "^[^/]*", 0)), r"^www\.", ""), ":(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(place, "^[^/]*(.*)$", 1), "/+$", "")
    params = F.array_sort(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))


def _fields(headers: Column) -> Column:
    """Header fields by lower-case name; the first of several with one name holds."""
    listed = F.array_sort(F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")))
    low = F.transform(listed, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(low, lambda e: e["key"])
    return F.map_from_entries(F.filter(low, lambda e, i: F.array_position(names, e["key"]) == i + 1))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(captures: DataFrame, slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """One row per revisit of ``captures`` (record_id, url, ts in seconds, status, headers map).

    Returns record_id, url (canonical), ts, refers_to, outcome and headers. A full response has status 200, a revisit
    304; other rows, and rows without URL, time or status, count as neither. At equal times a response counts as earlier than
    a revisit, and of responses the largest record_id is the latest. outcome: "resolved" if the first validator that the
    revisit carries (etag, compared weakly, else last-modified) is that of the response, "unvalidated" if it carries
    none, "mismatch" if they differ, "missing" without an earlier response. The first two get the response's headers with
    the permitted fields of the revisit put over them, the others keep their own. Repeated rows give repeated results.
    """
    rows = captures.select(
        "record_id", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), F.col("status").cast("int").alias("status"),
        _fields(F.col("headers")).alias("h")).where(F.col("url").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(200, 304))
    rows = rows.withColumn("slot", F.floor(F.col("ts") / slot_seconds))
    full = F.when(F.col("status") == 200, F.struct("ts", "record_id", F.map_entries("h").alias("h")))
    lasts = rows.groupBy("url", "slot").agg(F.max(full).alias("last"))
    earlier = Window.partitionBy("url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = lasts.select("url", "slot", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    inside = Window.partitionBy("url", "slot").orderBy("ts", "status", "record_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("here", F.last(full, ignorenulls=True).over(inside)).where("status = 304")
    found = placed.join(before, ["url", "slot"], "left").withColumn("was", F.coalesce("here", "before"))
    stored = F.map_from_entries(F.col("was.h"))
    mine, tag, since = F.col("h"), F.col("h")["etag"], F.col("h")["last-modified"]
    outcome = (
        F.when(F.col("was").isNull(), "missing")
        .when(tag.isNotNull(), F.when(_weak(tag) == _weak(stored["etag"]), "resolved").otherwise("mismatch"))
        .when(since.isNotNull(), F.when(since == stored["last-modified"], "resolved").otherwise("mismatch"))
        .otherwise("unvalidated"))
    update = F.map_filter(mine, lambda k, v: k.isin(UPDATES))
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.coalesce(F.map_contains_key(update, k), F.lit(False))), update)
    good = F.col("outcome").isin("resolved", "unvalidated")
    return found.withColumn("outcome", outcome).select(
        "record_id", "url", "ts", F.when(good, F.col("was.record_id")).alias("refers_to"), "outcome",
        F.when(good, merged).otherwise(mine).alias("headers"))
