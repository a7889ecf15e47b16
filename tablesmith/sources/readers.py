"""Readers for the supported file formats."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablesmith.functions.text import as_type, joined_type, type_tests
from tablesmith.schema import nan_to_null, sanitize_columns, trim_columns
from tablesmith.session import scratch_path

# Texts that mean "missing" in delimited files.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
DELIMITERS = [",", ";", "\t", "|"]
TEXT_DELIMITERS = [",", "\t", ";", "|"]
SNIFF_BYTES = 1024
SNIFF_LINES = 5


def _head(spark: SparkSession, path: str, lines: int = 50) -> list[str]:
    """The first lines of the first file, each cut to the sniffing size."""
    rows = spark.read.text(path).select(F.substring("value", 1, SNIFF_BYTES + 1).alias("v")).limit(lines).collect()
    return [r["v"] for r in rows]


def pick_delimiter(lines: list[str], candidates: list[str] = DELIMITERS) -> str:
    """The first candidate that occurs equally often in the first non-blank lines, else a comma."""
    kept, size = [], 0
    for line in lines:
        size += len(line) + 1
        if size > SNIFF_BYTES and kept:
            break
        if line.strip():
            kept.append(line)
    kept = kept[:SNIFF_LINES]
    for d in candidates:
        counts = {line.count(d) for line in kept}
        if len(counts) == 1 and counts != {0}:
            return d
    return ","


def sniff_delimiter(spark: SparkSession, path: str, candidates: list[str] = DELIMITERS) -> str:
    return pick_delimiter(_head(spark, path), candidates)


def _file(df: DataFrame) -> DataFrame:
    """``df`` with the path of each row's file as readers take it."""
    return df.withColumn("_file", F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def file_traits(spark: SparkSession, path: str) -> dict[tuple[bool, bool], list[str]]:
    """Files by (valid UTF-8, quoted fields span lines), found in one pass over all bytes of all files.

    One row per file reaches the driver, which lists the files in any case.
    """
    text = _file(spark.read.text(path))
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    rows = text.groupBy("_file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("spans")).collect()
    groups: dict[tuple[bool, bool], list[str]] = {}
    for r in sorted(rows):
        groups.setdefault((r["utf8"], r["spans"]), []).append(r["_file"])
    return groups


def _typed(df: DataFrame) -> DataFrame:
    """Give each text column the narrowest type that keeps all its values: bigint, decimal(38,0), double, boolean, else text."""
    def tests(c):
        v = F.col(f"`{c}`")
        return [*type_tests(v), F.count_if(~v.isin("True", "False", "true", "false", "TRUE", "FALSE"))]

    row = df.agg(*[e.alias(f"t{j}_{i}") for i, c in enumerate(df.columns) for j, e in enumerate(tests(c))]).first()
    casts = {}
    for i, c in enumerate(df.columns):
        *counts, no_bool = (row[f"t{j}_{i}"] for j in range(5))
        kind = joined_type(counts)
        if kind != "string":
            casts[c] = as_type(c, kind)
        elif not no_bool:
            casts[c] = F.lower(c) == "true"
    return df.withColumns(casts) if casts else df


def _raw(spark: SparkSession, path, sep: str, encoding: str, multiline: bool) -> DataFrame:
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False, quote='"', escape='"', multiLine=multiline)
    return df.toDF(*[c.strip() for c in df.columns])


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None, schema: T.StructType | None = None,
                   missing: list[str] = MISSING_TEXTS, multiline: bool | None = None) -> DataFrame:
    """Delimited text with a header. The texts in ``missing`` become NULL before types are decided.

    Without ``encoding`` and ``multiline`` a pass over the text decides them for every file on its own: UTF-8 unless
    the file is not valid (then Latin-1), and unsplittable multi-line parsing only where quoted fields span lines. Files of
    a kind are one scan, and the scans are put together by column name; a column that a file lacks is NULL there. With
    a schema there is no type pass.
    """
    if encoding is None or multiline is None:
        groups: dict[tuple[str, bool], list[str]] = {}
        for (utf8, spans), files in file_traits(spark, path).items():
            kind = encoding or ("UTF-8" if utf8 else "ISO-8859-1"), spans if multiline is None else multiline
            groups.setdefault(kind, []).extend(files)
    else:
        groups = {(encoding, multiline): []}
    if len(groups) < 2:
        raw = _raw(spark, path, sep, *next(iter(groups), ("UTF-8", False)))
    else:
        raw = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [_raw(spark, files, sep, *kind) for kind, files in sorted(groups.items())])
    blanked = raw.select(*[F.when(~F.col(f"`{c}`").isin(missing), F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        return _typed(blanked)
    return blanked.select(*[F.trim(F.col(f.name)).cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType)
                            else F.col(f.name) for f in schema.fields])


def read_csv_auto(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None, **kw) -> DataFrame:
    return read_delimited(spark, path, sep or sniff_delimiter(spark, path), encoding, **kw)


def read_tsv(spark: SparkSession, path: str, **kw) -> DataFrame:
    return read_delimited(spark, path, "\t", **kw)


class BrokenRecords(ValueError):
    """A file holds text that is no JSON."""


def split_records(text: str, name: str = "text") -> Iterator[str]:
    """The JSON values that stand one after the other in ``text``, arrays taken apart, each on one line.

    Follows brackets and strings, so layout means nothing. Broken text is an error that names the place.
    """
    scan, gap = json.JSONDecoder().raw_decode, re.compile(r"\s*")
    at, inside, wants = gap.match(text).end(), False, True
    while at < len(text):
        c = text[at]
        if not inside and c == "[":
            inside, at, wants = True, gap.match(text, at + 1).end(), True
            if text[at:at + 1] == "]":
                inside, at = False, gap.match(text, at + 1).end()
            continue
        if inside and not wants:
            if c == ",":
                at, wants = gap.match(text, at + 1).end(), True
                continue
            if c == "]":
                inside, at, wants = False, gap.match(text, at + 1).end(), True
                continue
            raise BrokenRecords(f"{name}: expected , or ] at character {at}")
        try:
            _, end = scan(text, at)
        except ValueError as e:
            raise BrokenRecords(f"{name}: no JSON value at character {at}: {e}") from None
        # Line breaks stand between tokens only; inside strings JSON has them escaped.
        yield re.sub(r"[\r\n]+", " ", text[at:end])
        at, wants = gap.match(text, end).end(), not inside
    if inside:
        raise BrokenRecords(f"{name}: the array does not end")


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Records as JSON: one or many arrays, values one after the other or spread over lines, decided for every file on its own.

    Files whose every line is a value of its own are read line by line, in parallel. Any other file is one task, which
    splits it into records; these are written to the shared folder and read like the others. A file that is no JSON
    fails the read with its name and the place.
    """
    lines = _file(spark.read.text(path)).where(F.trim("value") != "")
    rows = lines.groupBy("_file").agg(F.bool_and(F.try_parse_json("value").isNotNull()).alias("by_line")).collect()
    good, spread = [r["_file"] for r in rows if r["by_line"]], [r["_file"] for r in rows if not r["by_line"]]
    if spread:
        def split(batches):
            for batch in batches:
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    records = split_records(text.removeprefix("\ufeff"), name)
                    while part := list(itertools.islice(records, 1000)):
                        yield pa.record_batch([pa.array(part, pa.string())], names=["value"])

        whole = _file(spark.read.text(sorted(spread), wholetext=True)).select("_file", "value").repartition(len(spread), "_file")
        out = scratch_path(spark, "records")
        whole.mapInArrow(split, "value string").write.text(out)
        good.append(out)
    reader = (spark.read if schema is None else spark.read.schema(schema)).option("mode", "FAILFAST")
    return reader.json(sorted(good) if spread else path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


FORMATS = {
    ".csv": read_csv_auto,
    ".tsv": read_tsv,
    ".txt": lambda spark, path, **kw: read_delimited(spark, path, sniff_delimiter(spark, path, TEXT_DELIMITERS), **kw),
    ".json": read_json,
    ".parquet": lambda spark, path, **kw: read_parquet(spark, path),
}


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".encrypted")
    dot = name.rfind(".")
    return name[dot:].lower() if 0 < dot < len(name) - 1 else ""


def load(spark: SparkSession, path: str, fmt: str | None = None, sanitize: bool = True, **kw) -> DataFrame:
    """Load a file (or a folder of parts) by its extension; cells and names are sanitised by default."""
    from tablesmith.operators.sanitizing import sanitize_frame

    ext = extension(path) if fmt is None else "." + fmt.lstrip(".").lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported file format: {ext or path}")
    df = nan_to_null(trim_columns(FORMATS[ext](spark, path, **kw)))
    return sanitize_frame(df) if sanitize else sanitize_columns(df)


AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StructType([
        *[T.StructField(c, T.StringType()) for c in (
            "timestamp", "event_type", "user_id", "session_id", "ip_address", "user_agent", "resource", "action", "outcome")],
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
        T.StructField("risk_level", T.StringType()),
    ])),
])


def flatten_audit(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("timestamp").alias("logged_at"), "level", F.try_to_timestamp("message.timestamp").alias("ts"),
        *[f"message.{c}" for c in ("event_type", "user_id", "session_id", "ip_address", "user_agent", "resource", "action", "outcome",
                                   "risk_level", "details")])


def read_audit_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines security log, one flat row per event; details stay a map."""
    return flatten_audit(spark.read.schema(AUDIT_SCHEMA).json(path))
