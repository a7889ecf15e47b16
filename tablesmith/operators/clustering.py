"""Customer segments by k-means on standardised columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tablesmith.functions.formats import label_map
from tablesmith.operators.features import fit_scaler

# Names of the four segments by cluster number.
SEGMENT_LABELS = {0: "High Value", 1: "Growth Potential", 2: "At Risk", 3: "Standard"}


def segment(df: DataFrame, cols: Sequence[str], k: int = 4, seed: int = 42, labels: dict[int, str] | None = None) -> DataFrame:
    """Add ``segment`` and ``segment_label``. Rows with a missing value are left out.

    Segments are numbered by the mean of the first column, smallest first, so labels do not hang on the random start.
    """
    cols = list(cols)
    rows = df.na.drop(subset=cols)
    scaler = fit_scaler(rows, cols, "standard")
    scaled = rows.withColumns({f"_z_{i}": scaler.expr(c) for i, c in enumerate(cols)})
    vectors = VectorAssembler(inputCols=[f"_z_{i}" for i in range(len(cols))], outputCol="_features").transform(scaled)
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="segment", maxIter=50).fit(vectors)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))
    place = F.array(*[F.lit(order.index(i)) for i in range(len(order))])
    out = model.transform(vectors).drop("_features", *[f"_z_{i}" for i in range(len(cols))]).withColumn("segment", F.get(place, F.col("segment")))
    return out.withColumn("segment_label", label_map("segment", labels or SEGMENT_LABELS))


def segment_summary(df: DataFrame, cols: Sequence[str], by: str = "segment_label") -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 2).alias(f"{c}_mean") for c in cols])
