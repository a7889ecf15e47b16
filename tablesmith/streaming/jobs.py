"""Stream jobs: audit routing, upload ingest, scoring, notifications."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tablesmith.operators.audit import severity
from tablesmith.operators.sanitizing import sanitize_frame
from tablesmith.streaming.events import drain, file_stream

LEVELS = ["WARNING", "ERROR", "CRITICAL"]


def with_severity(df: DataFrame) -> DataFrame:
    return df.withColumn("severity", severity(F.col("risk_level"), F.col("outcome"), F.col("event_type")))


def audit_stream(sdf: DataFrame, audit_path: str, security_path: str, checkpoint: str | None = None) -> None:
    """Every event to the audit table, WARNING and above also to the security table."""

    def route(batch: DataFrame, batch_id: int) -> None:
        # Both sinks are overwritten per batch id, so a repeated batch leaves no doubles. The second reads what the first wrote.
        batch.write.mode("overwrite").parquet(f"{audit_path}/batch={batch_id}")
        done = batch.sparkSession.read.schema(batch.schema).parquet(f"{audit_path}/batch={batch_id}")
        done.where(F.col("severity").isin(LEVELS)).write.mode("overwrite").parquet(f"{security_path}/batch={batch_id}")

    drain(with_severity(sdf), "append", checkpoint, route)


def ingest_stream(spark: SparkSession, in_dir: str, schema, fmt: str = "parquet", required: list[str] | None = None,
                  glob: str | None = None, **kw) -> DataFrame:
    """Uploaded files as a stream: sanitised cells and names, and whether each row has all required values."""
    clean = sanitize_frame(file_stream(spark, in_dir, schema, fmt, glob, **kw))
    complete = F.lit(True)
    for c in required or []:
        complete = complete & F.col(c).isNotNull()
    return clean.withColumn("is_valid", complete)


def upload_rules(df: DataFrame, required: list[str], max_chars: int | None = None) -> dict[str, Column]:
    """Why a sanitised row is refused: required values that are missing or blank, numbers that are none, texts beyond ``max_chars``."""
    rules = {}
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if f.name in required:
            rules[f"missing {f.name}"] = c.isNull()
            if kind == "string":
                rules[f"blank {f.name}"] = F.trim(c) == ""
        if kind in ("double", "float"):
            rules[f"not finite {f.name}"] = F.isnan(c) | (F.abs(c) == float("inf"))
        if kind == "string" and max_chars is not None:
            rules[f"too long {f.name}"] = F.char_length(c) > max_chars
    return rules


class CheckedIngest:
    """Uploads as a stream: sanitised, judged row by row, and written to an accepted and a refused table.

    A batch is computed and written once, with the verdict as a partition, below its own id: repeated batches leave no
    doubles, and both tables always agree.
    """

    def __init__(self, out: str, required: list[str], max_chars: int | None = None) -> None:
        self.out, self.required, self.max_chars = out, required, max_chars

    def judged(self, sdf: DataFrame) -> DataFrame:
        clean = sanitize_frame(sdf)
        rules = upload_rules(clean, self.required, self.max_chars)
        reasons = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()])) if rules else F.array().cast("array<string>")
        self.columns = clean.schema
        return clean.withColumn("_reasons", reasons).withColumn("_refused", F.size("_reasons") > 0)

    def write(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("_refused").parquet(f"{self.out}/batch={batch_id}")

    def _table(self, spark: SparkSession, refused: bool) -> DataFrame:
        added = T.StructType.fromDDL("_reasons array<string>, _refused boolean, batch bigint")
        schema = T.StructType([*self.columns.fields, *added.fields])
        return spark.read.schema(schema).parquet(self.out).where(F.col("_refused") == refused)

    def accepted(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, False).drop("_reasons", "_refused", "batch")

    def refused(self, spark: SparkSession) -> DataFrame:
        """The refused rows as they came after sanitising, with all reasons."""
        return self._table(spark, True).withColumnRenamed("_reasons", "reasons").drop("_refused", "batch")


def score_stream(model: PipelineModel, sdf: DataFrame) -> DataFrame:
    out = model.transform(sdf)
    return out.drop(*[c for c in out.columns if c == "_features" or c.startswith("_x_")])


def notifications(df: DataFrame, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One record per row and matching rule: ``kind`` and ``message`` next to the row's columns."""
    found = F.array(*[
        F.when(test, F.struct(F.lit(kind).alias("kind"), text.alias("message"))) for kind, (test, text) in rules.items()])
    return df.select("*", F.explode(found).alias("_x")).where("_x IS NOT NULL").select(*df.columns, "_x.*")
