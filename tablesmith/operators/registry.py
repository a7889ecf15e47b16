"""Model and dataset records kept as append-only Parquet tables; the newest version of a record counts."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

MODEL_SCHEMA = (
    "model_id string, version long, name string, model_type string, dataset_id string, owner_id string, target string, "
    "features array<string>, metrics map<string,double>, importance map<string,double>, artefact string, "
    "created timestamp, is_active boolean"
)
DATASET_SCHEMA = (
    "dataset_id string, parent_id string, name string, path string, n_rows long, n_columns int, "
    "parent_rows long, parent_columns int, details string, created timestamp"
)


def _latest(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def register(records: DataFrame, path: str) -> None:
    """Append records; columns that are not given are null, version 0, active."""
    spark = records.sparkSession
    template = spark.createDataFrame([], MODEL_SCHEMA)
    defaults = {"version": F.lit(0), "is_active": F.lit(True)}
    cols = [
        (F.col(f.name) if f.name in records.columns else defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in template.schema.fields]
    records.select(*cols).write.mode("append").parquet(path)


def list_models(spark: SparkSession, path: str, include_inactive: bool = False, **filters) -> DataFrame:
    """Newest first."""
    rows = _latest(spark.read.schema(MODEL_SCHEMA).parquet(path), "model_id")
    if not include_inactive:
        rows = rows.where("is_active")
    for c, v in filters.items():
        rows = rows.where(F.col(c) == F.lit(v))
    return rows.orderBy(F.desc("created"), "model_id")


def model_info(spark: SparkSession, path: str, model_id: str) -> DataFrame:
    return list_models(spark, path, True, model_id=model_id)


def deactivate(spark: SparkSession, path: str, condition: Column) -> None:
    """Soft delete: append a newer, inactive version of the matching records."""
    current = _latest(spark.read.schema(MODEL_SCHEMA).parquet(path), "model_id").where(F.col("is_active") & condition)
    current.withColumns({"version": F.col("version") + 1, "is_active": F.lit(False)}).write.mode("append").parquet(path)


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_report(models: DataFrame) -> DataFrame:
    """Facts, metrics and importance of each model: ``model_id, section, item, value, rank``."""
    facts = models.select("model_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).cast("string").alias("value")) for c in ("name", "model_type", "target")])).alias("_x"))
    facts = facts.select("model_id", F.lit("model").alias("section"), "_x.item", "_x.value", F.lit(0).alias("rank"))
    metrics = models.select("model_id", F.explode("metrics").alias("item", "v")).select(
        "model_id", F.lit("performance").alias("section"), "item", F.round("v", 4).cast("string").alias("value"), F.lit(0).alias("rank"))
    w = Window.partitionBy("model_id").orderBy(F.desc("v"), "item")
    importance = models.select("model_id", F.explode("importance").alias("item", "v")).select(
        "model_id", F.lit("importance").alias("section"), "item", F.round("v", 4).cast("string").alias("value"),
        F.row_number().over(w).alias("rank"))
    return facts.unionByName(metrics).unionByName(importance)


def record_lineage(path: str, child: DataFrame, parent: DataFrame, dataset_id: str, parent_id: str, name: str,
                   location: str, created: Column, options: dict | None = None, log: list[str] | None = None) -> DataFrame:
    """Append one row about a derived dataset: parent, options, log, shape before and after."""
    spark = child.sparkSession
    details = json.dumps({"options": options or {}, "log": log or []}, sort_keys=True)
    row = child.agg(F.count("*").alias("n_rows")).select(
        F.lit(dataset_id).alias("dataset_id"), F.lit(parent_id).alias("parent_id"), F.lit(name).alias("name"),
        F.lit(location).alias("path"), "n_rows", F.lit(len(child.columns)).alias("n_columns"),
        F.lit(parent.count()).cast("long").alias("parent_rows"), F.lit(len(parent.columns)).alias("parent_columns"),
        F.lit(details).alias("details"), created.cast("timestamp").alias("created"))
    row.write.mode("append").parquet(path)
    return spark.read.schema(DATASET_SCHEMA).parquet(path)
