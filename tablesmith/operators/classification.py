"""Neural-network classification and its accuracy.

Hidden layers are sigmoid and the output is softmax (what Spark's perceptron offers); dropout and
learning-rate schedules have no counterpart.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from tablesmith.operators.features import fit_encoder, fit_scaler

# Hidden layers of the documented architectures.
ARCHITECTURES = {
    "simple": [64, 32, 16],
    "deep": [128, 64, 32, 16, 8],
    "classification": [64, 32, 16],
}


@dataclass
class FittedClassifier:
    model: PipelineModel
    features: list[str]
    classes: DataFrame      # value, code

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (class code), ``probabilities`` and ``confidence``."""
        out = self.model.transform(df)
        out = out.withColumn("probabilities", vector_to_array("_probability"))
        return out.withColumns({"confidence": F.array_max("probabilities"), "prediction": F.col("prediction").cast("int")}).drop(
            "_features", "_probability", "_raw", *[c for c in out.columns if c.startswith("_x_")])


def fit_mlp(df: DataFrame, target: str, features: Sequence[str], arch: str = "simple", seed: int = 42, max_iter: int = 100) -> FittedClassifier:
    """Standard-scaled numeric features to classes; missing features get the training mean."""
    features = list(features)
    rows = df.where(F.col(target).isNotNull())
    means = rows.agg(*[F.coalesce(F.avg(f), F.lit(0.0)).alias(f) for f in features]).first().asDict()
    filled = rows.na.fill({f: float(m) for f, m in means.items()})
    scaler = fit_scaler(filled, features, "standard")
    encoder = fit_encoder(rows, [target])
    cols = ", ".join(
        f"(coalesce(CAST(`{f}` AS DOUBLE), {float(means[f])!r}D) - ({scaler.centre[f]!r}D)) / ({scaler.spread[f]!r}D) AS `_x_{i}`"
        for i, f in enumerate(features))
    prepare = PipelineModel([
        SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__"),
        VectorAssembler(inputCols=[f"_x_{i}" for i in range(len(features))], outputCol="_features"),
    ])
    data = prepare.transform(encoder.apply(rows)).withColumn("_label", F.col(f"{target}_code").cast("double"))
    net = MultilayerPerceptronClassifier(
        layers=[len(features), *ARCHITECTURES[arch], max(encoder.sizes[target], 2)], featuresCol="_features", labelCol="_label",
        predictionCol="prediction", probabilityCol="_probability", rawPredictionCol="_raw", seed=seed, maxIter=max_iter)
    # Training passes over the data many times: keep only vectors and labels, spilling to disk.
    kept = data.select("_features", "_label").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = net.fit(kept)
    finally:
        kept.unpersist()
    return FittedClassifier(PipelineModel([*prepare.stages, fitted]), features, encoder.vocabularies[target])


def accuracy(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.avg((F.col(actual) == F.col(predicted)).cast("int")).alias("accuracy"))
