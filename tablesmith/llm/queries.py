"""The registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.llm import alignment, crf, decontaminate, lbl, mixing, passages, pii, pivots, prefixes, revisits, simhash, toxicity, wrappers
from tablesmith.llm.common import fold, free_shuffles
from tablesmith.plans.base import query, table

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op2_simhash_bk_trees")
def op2(spark, sf_dir):
    free_shuffles(spark)
    near = simhash.near_copies(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{decontaminate.WORD}'), []) AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{decontaminate.WORD}'), []) AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, w[p:p + 9] AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM i WHERE len(w) >= 10)
  UNION SELECT item_id, w FROM i WHERE len(w) BETWEEN 1 AND 9),
sizes AS (SELECT DISTINCT len(gram) AS n FROM g),
places AS (SELECT doc_id, n, p, w[p:p + n - 1] AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes)),
h AS (SELECT doc_id, p, n, item_id FROM places JOIN g USING (gram)),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op7_benchmark_ngrams", OP7_SQL)
def op7(spark, sf_dir):
    free_shuffles(spark)
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


# The patterns as the contract states them; the operator's own forms match the same spans.
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _op8_sql() -> str:
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(range(1, len({digits}) + 1), lambda k: CASE WHEN (len({digits}) - k) % 2 = 0 THEN CAST({digits}[k] AS INT) "
            f"WHEN CAST({digits}[k] AS INT) > 4 THEN CAST({digits}[k] AS INT) * 2 - 9 ELSE CAST({digits}[k] AS INT) * 2 END)) % 10 = 0")
    valid = {
        "email": "true",
        "ip": "len(list_filter(string_split(m, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0",
        "card": f"len({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"len({digits}) BETWEEN 9 AND 15",
    }
    parts, names = ["WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], []
    for i, (kind, p) in enumerate(_SQL_PATTERNS.items()):
        parts.append(f"""
m{i} AS (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d),
e{i} AS (SELECT doc_id, unnest(range(1, len(ms) + 1)) AS k, ms, gs FROM m{i}),
s{i} AS (SELECT doc_id, ms[k] AS m, list_sum(list_transform(gs[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0) AS s FROM e{i}),
k{i} AS (SELECT doc_id, count(*) AS n, string_agg('{kind}:' || CAST(s AS BIGINT) || ':' || CAST(s + length(m) AS BIGINT), ',' ORDER BY s) AS l FROM s{i} WHERE {valid[kind]} GROUP BY doc_id)""")
        names.append(kind)
    counts = ", ".join(f"CAST(coalesce(k{i}.n, 0) AS BIGINT) AS n_{k}" for i, k in enumerate(names))
    joins = " ".join(f"LEFT JOIN k{i} USING (doc_id)" for i in range(4))
    return ",".join(parts) + f"\nSELECT doc_id, {counts}, sha256(concat_ws(',', k0.l, k1.l, k2.l, k3.l)) AS base_sha256 FROM d {joins}"


#: The base spans in SQL; tests hold op8 against it, since the query itself also returns the added spans.
OP8_BASE_SQL = _op8_sql()


@query("op8_personal_data")
def op8(spark, sf_dir):
    found = pii.spans(table(spark, sf_dir, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[count(k) for k in pii.BASE],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"))


@query("op3_line_field_quality")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    field = crf.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), crf.quality(field, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= crf.ACCEPT).cast("int"))


def _op9_sql() -> str:
    cells = """
WITH d AS (
  SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, coalesce(text, '') AS text FROM documents),
t AS (
  SELECT doc_id, source, lang, CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
         CASE WHEN regexp_matches(text, '[A-Za-z0-9]@[A-Za-z0-9]|\\+[0-9]') THEN 'contact' WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'licence'
              WHEN contains(text, '|') THEN 'table' WHEN length(text) < 400 THEN 'short' ELSE 'prose' END AS topic
  FROM d),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS n FROM t GROUP BY ALL),
""" + ",\n".join(f"a_{m} AS (SELECT {m}, sqrt(sum(n)) / sum(sqrt(sum(n))) OVER () AS aim FROM c GROUP BY {m})" for m in mixing.MARGINS)
    steps, last = [], "w0"
    steps.append("w0 AS MATERIALIZED (SELECT *, n / sum(n) OVER () AS w FROM c)")
    for i in range(mixing.SWEEPS):
        for m in mixing.MARGINS:
            name = f"w{i}_{m}"
            steps.append(f"{name} AS MATERIALIZED (SELECT source, lang, topic, n, w * aim / sum(w) OVER (PARTITION BY {m}) AS w FROM {last} JOIN a_{m} USING ({m}))")
            last = name
    end = f"""
f AS (SELECT source, lang, topic, w * (SELECT sum(n) FROM c) / n AS weight FROM {last} WHERE n > 0),
g AS (SELECT *, least(1.0, weight) AS p, greatest(1.0, weight) AS again FROM f)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(p, 6) AS probability, round(again, 6) AS repeat,
       CAST(('0x' || substr(md5('7:' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0 < p AS kept
FROM t JOIN g USING (source, lang, topic)
"""
    return cells + ",\n" + ",\n".join(steps) + "," + end


@query("op9_raked_mixture", _op9_sql())
def op9(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.round("_repeat", 6).alias("repeat"),
        F.col("_kept").alias("kept"))


def captures(spark, sf_dir):
    """Each page as a full response and a later revisit; validators and times follow from the page.

    Every fourth revisit names another tag, every fifth no validator, every seventh comes before its response.
    """
    p = table(spark, sf_dir, "pages")
    i, tag = F.col("page_id"), F.md5(F.coalesce(F.col("html"), F.lit("")))
    size = F.char_length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    day = F.concat(F.lit("day "), i.cast("string"))
    first = F.struct(
        (i * 2).alias("record_id"), "url", (i * 60).alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), F.concat(F.lit('"'), tag, F.lit('"')), F.lit("Content-Length"), size, F.lit("Date"), day).alias("headers"))
    again = F.struct(
        (i * 2 + 1).alias("record_id"), "url", F.when(i % 7 == 0, i * 60 - 30).otherwise(i * 60 + 5000).alias("ts"), F.lit(304).alias("status"),
        F.map_concat(
            F.when(i % 5 == 0, F.create_map().cast("map<string,string>")).when(i % 4 == 0, F.create_map(F.lit("etag"), F.lit('"other"')))
            .otherwise(F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), tag, F.lit('"')))),
            F.create_map(F.lit("date"), F.concat(day, F.lit(" again")), F.lit("content-length"), F.lit("0"))).alias("headers"))
    return p.select(F.inline(F.array(first, again)))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id AS i, md5(coalesce(html, '')) AS tag, CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
         regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE url IS NOT NULL),
q AS (
  SELECT i, tag, size, regexp_replace(bare, '\?.*$', '') AS place,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
                               lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)(?:=|$)'))) AS params FROM p),
u AS (
  SELECT i, tag, size,
         regexp_replace(regexp_replace(lower(regexp_extract(place, '^[^/]*')), '^www\.', ''), ':(?:80|443)$', '')
         || regexp_replace(regexp_extract(place, '^[^/]*(.*)$', 1), '/+$', '')
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM q),
f AS (SELECT i * 2 AS id, url, i * 60 AS ts, tag, size, i FROM u),
r AS (SELECT i * 2 + 1 AS id, url, CASE WHEN i % 7 = 0 THEN i * 60 - 30 ELSE i * 60 + 5000 END AS ts, i,
             CASE WHEN i % 5 = 0 THEN NULL WHEN i % 4 = 0 THEN 'other' ELSE tag END AS tag, CASE WHEN i % 5 <> 0 AND i % 4 <> 0 THEN 'W/' ELSE '' END AS w FROM u),
m AS (
  SELECT r.id, r.url, r.ts, r.i, r.tag, r.w, f.id AS was, f.tag AS ftag, f.size,
         row_number() OVER (PARTITION BY r.id ORDER BY f.ts DESC NULLS LAST, f.id DESC) AS k
  FROM r LEFT JOIN f ON f.url = r.url AND f.ts <= r.ts),
o AS (SELECT *, CASE WHEN was IS NULL THEN 'missing' WHEN tag IS NULL THEN 'unvalidated' WHEN tag = ftag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM m WHERE k = 1)
SELECT id AS record_id, url, CAST(ts AS BIGINT) AS ts, CASE WHEN outcome IN ('resolved', 'unvalidated') THEN was END AS refers_to, outcome,
       'content-length=' || CASE WHEN outcome IN ('resolved', 'unvalidated') THEN size ELSE '0' END || ';date=day ' || i || ' again'
       || CASE WHEN tag IS NOT NULL THEN ';etag=' || w || '"' || tag || '"' WHEN outcome = 'unvalidated' THEN ';etag="' || ftag || '"' ELSE '' END AS headers
FROM o
"""


@query("op10_revisit_resolution", OP10_SQL)
def op10(spark, sf_dir):
    found = revisits.resolve(captures(spark, sf_dir))
    listed = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(listed, ";"))


@query("op1_passage_automata")
def op1(spark, sf_dir):
    free_shuffles(spark)
    return passages.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


@query("op4_pivot_permutations")
def op4(spark, sf_dir):
    free_shuffles(spark)
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op5_log_bilinear")
def op5(spark, sf_dir):
    free_shuffles(spark)
    return lbl.train_and_score(table(spark, sf_dir, "documents"))


@query("op6_wrapper_induction")
def op6(spark, sf_dir):
    free_shuffles(spark)
    return wrappers.main_text(table(spark, sf_dir, "pages"))


@query("op11_tokenizer_alignment")
def op11(spark, sf_dir):
    free_shuffles(spark)
    return alignment.align(table(spark, sf_dir, "documents"), with_groups=False).drop("groups")


#: The CRC-32 of the id's decimal digits, bit by bit; the constants are the checksum's own.
_CRC = """
xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda u, i: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END, xor(a, b)),
    CAST(4294967295 AS BIGINT)), 4294967295) % 6
"""
OP12_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
                            sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, {_CRC} AS h FROM (SELECT DISTINCT conv_id AS c FROM t)),
r AS (
  SELECT c, 0 AS part, p, k, chars FROM i JOIN t ON t.conv_id = c - c % 100 AND p <= h
  UNION ALL SELECT c, 1, p, k, chars FROM i JOIN t ON t.conv_id = c AND p > h),
n AS (SELECT c, k, chars, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d FROM r),
s AS (
  SELECT c, d, chars, sha256(string_agg(k, ',') OVER (PARTITION BY c ORDER BY d)) AS path FROM n
  UNION ALL SELECT c, 0, 0, 'root' FROM i),
z AS (SELECT c, max(d) AS last FROM s GROUP BY c),
u AS (SELECT d, path, min(c) AS conv, count(*) AS n_convs, min(chars) AS chars FROM s GROUP BY d, path),
up AS (SELECT u.d, u.path, s.path AS above FROM u JOIN s ON s.c = u.conv AND s.d = u.d - 1),
kids AS (SELECT above AS path, d - 1 AS d, count(*) AS n FROM up GROUP BY ALL),
v AS (SELECT u.*, coalesce(kids.n, 0) AS n_children, (u.n_convs - 1) * u.chars AS saved FROM u LEFT JOIN kids USING (d, path)),
sums AS (
  SELECT s.d, s.path, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(v.saved) AS saved
  FROM v JOIN s ON s.c = v.conv AND s.d <= v.d GROUP BY ALL),
ends AS (SELECT s.d, s.path, sha256(string_agg(CAST(s.c AS VARCHAR), ',' ORDER BY s.c)) AS h FROM s JOIN z ON z.c = s.c AND z.last = s.d GROUP BY ALL)
SELECT v.conv AS conv_id, CAST(v.d AS BIGINT) AS depth, a.conv AS parent_conv_id, v.n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       CAST(sums.n_leaves AS BIGINT) AS n_leaves, CAST(sums.saved AS BIGINT) AS saved_tokens, coalesce(ends.h, sha256('')) AS ends_sha256
FROM v JOIN sums USING (d, path) LEFT JOIN ends USING (d, path) LEFT JOIN up USING (d, path) LEFT JOIN u a ON a.d = v.d - 1 AND a.path = up.above
"""


@query("op12_prefix_tries", OP12_SQL)
def op12(spark, sf_dir):
    free_shuffles(spark)
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations"))


@query("op13_toxic_span_field")
def op13(spark, sf_dir):
    free_shuffles(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), toxicity.toxicity(model, F.col("text")).alias("_it"))
    return scored.select("doc_id", "held_out", "_it.score", (F.col("_it.score") >= toxicity.ACCEPT).cast("int").alias("predicted"), "_it.spans")
