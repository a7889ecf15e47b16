"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tablesmith.schema import numeric_columns


def export_metadata(df: DataFrame, dataset_id: str, created: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(
        F.lit(dataset_id).alias("dataset_id"), created.alias("export_date"), "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair]).alias("data_types"))


def export(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists", partition_by: list[str] | None = None,
           metadata: tuple[str, Column] | None = None, **options) -> str:
    """Write as csv, tsv, json or parquet. ``metadata=(dataset id, date)`` adds ``<path>.metadata``."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt in ("csv", "tsv"):
        writer.csv(path, header=True, sep=options.pop("sep", "\t" if fmt == "tsv" else ","), escape='"', **options)
    elif fmt == "json":
        writer.json(path, ignoreNullFields=False, **options)
    elif fmt == "parquet":
        writer.parquet(path, **options)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
    if metadata:
        export_metadata(df, *metadata).write.mode(mode).json(f"{path}.metadata")
    return path


def write_predictions(df: DataFrame, path: str, model_id: str, created: Column, actual: str | None = None, fmt: str = "parquet") -> str:
    """Input columns with prediction, residual when the truth is known, model id and time."""
    out = df.withColumns({"model_id": F.lit(model_id), "predicted_at": created})
    if actual and actual in numeric_columns(df):
        out = out.withColumn("residual", F.col(actual) - F.col("prediction"))
    return export(out, path, fmt)
