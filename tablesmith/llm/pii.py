"""Personal data: regular expressions propose spans, checksums and ranges confirm them, nearby words adjust the score.

DataFrame functions only. Offsets come from the text between the matches: ``split`` and ``regexp_extract_all`` find the
same matches, so running lengths of both give starts and ends in code points. The patterns are the base patterns with
possessive repeats and a guard on where a match may start, which match the same spans in time linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.llm.common import packed, unpacked

# How many characters the account numbers of a country have.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21,
    "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26}
#: A country's number has its length, whatever follows; other countries' numbers go on as far as they can.
_IBAN = (
    r"(?<![A-Za-z0-9])(?:" + "|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for c, n in IBAN_LENGTHS.items())
    + r"|(?!" + "|".join(IBAN_LENGTHS) + r")[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
#: kind: (pattern, score before context, words that raise it, needs context to count)
#: Base kinds always count; the score tells how sure a span is.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"[0-9]++(?:\.[0-9]++){3}", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.7),
}
ADDED = {
    "iban": (_IBAN, 0.7),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3),
    "tel": (r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])", 0.3),
}
KINDS = [*BASE, *ADDED]
#: Words next to a span that raise its score by ``CONTEXT``.
NEAR = {
    "email": "mail|email|contact|kontakt|correo|courriel",
    "ip": "ip|host|server|address|adresse",
    "card": "card|visa|mastercard|amex|credit|karte|tarjeta|carte",
    "phone": "phone|call|tel|mobile|telefon|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social|security",
    "tel": "phone|call|tel|mobile|fax|contact",
}
CONTEXT, WINDOW, ACCEPT = 0.3, 40, 0.5
SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def _matches(text: Column, kind: str, pattern: str, gate: Column) -> Column:
    """All confirmed matches as (kind, start, end, text) in code points; the gate spares texts that can't match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"), F.char_length(m).alias("n")))
    empty = F.struct(F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>").alias("out"), F.lit(0).alias("at"))
    # Only confirmed matches are gathered, so a text full of numbers stays cheap.
    walked = F.aggregate(
        steps, empty,
        lambda a, s: F.struct(
            F.when(_valid(kind, s["m"]), F.array_append(a["out"], F.struct(
                F.lit(kind).alias("kind"), (a["at"] + s["g"]).alias("start"), (a["at"] + s["g"] + s["n"]).alias("end"),
                s["m"].alias("text")))).otherwise(a["out"]).alias("out"),
            (a["at"] + s["g"] + s["n"]).alias("at")))["out"]
    return F.when(gate, walked).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>"))


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a right Luhn check digit."""
    parts = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2))
    return F.aggregate(parts, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks has remainder 1 by 97, its first four characters moved to the end."""
    turned = F.split(F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4)), "")
    return F.aggregate(
        F.filter(turned, lambda c: c != ""), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _valid(kind: str, text: Column) -> Column:
    digits = _digits(text)
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        return F.char_length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(text, " ", ""))
    if kind == "ssn":
        return ~text.rlike("^(?:000|666|9)") & ~text.rlike("-00-") & ~text.rlike("0000$")
    return F.lit(True)


def _scorer(text: Column, kind: str, score: float):
    def scored(m: Column) -> Column:
        around = F.substring(text, F.greatest(m["start"] - WINDOW, F.lit(0)) + 1, m["end"] - m["start"] + 2 * WINDOW)
        near = around.rlike(rf"(?i)(?<![a-z])(?:{NEAR[kind]})(?![a-z])")
        sure = F.least(F.lit(1.0), F.lit(score) + F.when(near, F.lit(CONTEXT)).otherwise(F.lit(0.0)))
        return F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), F.round(sure, 3).alias("score"))

    return scored


def _gate(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    if kind == "ip":
        return text.rlike(r"[0-9]\.[0-9]")
    if kind in ("ssn", "tel"):
        return text.rlike("[0-9]{3}-[0-9]")
    if kind == "iban":
        return text.rlike("[A-Z]{2}[0-9]{2}")
    return text.rlike("[0-9][\\x20-]?[0-9]")


def with_spans(docs: DataFrame, text_col: str = "text", prefix: str = "_") -> DataFrame:
    """``docs`` with one column of spans per kind, named prefix + kind: array of (kind, start, end, text, score).

    Null text counts as empty and has no spans. Each row is judged by itself, so repeated rows, ties and further
    columns change nothing; columns that already have such a name are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.withColumns({f"{prefix}{k}": _matches(text, k, p, _gate(text, k)) for k, (p, _) in (BASE | ADDED).items()})
    out = {}
    for kind, (_, score) in (BASE | ADDED).items():
        scored = F.transform(F.col(f"{prefix}{kind}"), _scorer(text, kind, score))
        out[f"{prefix}{kind}"] = scored if kind in BASE else F.filter(scored, lambda m: m["score"] >= ACCEPT)
    return raw.withColumns(out)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, all): spans of the base kinds, and of all kinds, by kind as listed and then start."""
    found = with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    return found.select(
        "doc_id", F.concat(*[F.col(f"_{k}") for k in BASE]).alias("base"), F.concat(*[F.col(f"_{k}") for k in KINDS]).alias("all"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; of overlapping spans the earliest one names it.

    A null text stays null. All other columns stay as they are, whatever their names.
    """
    found = with_spans(packed(docs, text=F.col(text_col)))
    text = F.col("text")
    ordered = F.array_sort(F.transform(
        F.concat(*[F.col(f"_{k}") for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("at"))
    walked = F.aggregate(
        ordered, empty,
        lambda a, s: F.struct(
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
                a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("<"), s["kind"], F.lit(">"))))).alias("out"),
            F.greatest(a["at"], s["end"]).alias("at")),
        lambda a: F.concat(F.concat_ws("", a["out"]), F.substring(text, a["at"] + 1, 2147483647)))
    return unpacked(found, docs.columns, **{text_col: F.when(F.size(ordered) > 0, walked).otherwise(text)})
