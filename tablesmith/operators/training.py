"""The training of a regression from table to record: split, select, tune, fit, measure, save, and score again later."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablesmith.operators import correlation, features as ft, regression, registry
from tablesmith.operators.regression import FittedRegression, RegressionConfig


@dataclass
class TrainingPlan:
    target: str
    features: list[str]
    key: str                         # tells rows apart; split and folds hash it
    config: RegressionConfig = field(default_factory=RegressionConfig)
    select: int | None = None        # keep so many features by F statistic on training rows
    tune: bool = False               # search the model type's grid by cross-validation on training rows
    test: float = 0.2
    folds: int = 5
    seed: int = 42


@dataclass
class Trained:
    plan: TrainingPlan
    fitted: FittedRegression
    report: DataFrame

    def save(self, artefact: str, records: str, model_id: str, name: str, dataset_id: str, owner_id: str, created: Column) -> None:
        """Write the model and append its record: features, test figures and importance included."""
        registry.save_model(self.fitted.model, artefact)
        of = lambda section: F.map_from_entries(F.collect_list(F.when(F.col("section") == section, F.struct("item", "value"))))
        record = self.report.agg(of("test").alias("metrics"), of("importance").alias("importance")).select(
            "*", *[F.lit(v).alias(n) for n, v in {
                "model_id": model_id, "name": name, "model_type": self.fitted.config.kind, "dataset_id": dataset_id, "owner_id": owner_id,
                "target": self.plan.target, "artefact": artefact}.items()],
            F.array(*[F.lit(f) for f in self.fitted.features]).alias("features"), created.alias("created"))
        registry.register(record, records)


def train(df: DataFrame, plan: TrainingPlan) -> Trained:
    """Fit and measure a model; the report has one row per figure: ``section, item, value``.

    All rows with a target take part; missing features (NULL or NaN) count as their mean over training rows. Only
    training rows decide on features, parameters, scaling and means. Sections: rows, parameters, coefficient, importance,
    train, test (r2, adjusted_r2, mse, mae, rmse, mape, explained_variance) and cross_validation.
    """
    spark = df.sparkSession
    rows, held = ft.split(df, plan.key, plan.test, plan.seed)
    names = list(plan.features)
    if plan.select is not None and plan.select < len(names):
        best = {r["feature"] for r in correlation.select_kbest(rows, names, plan.target, plan.select).collect()}
        names = [f for f in names if f in best]
    config = plan.config
    if plan.tune and regression.GRIDS[config.kind]:
        found = regression.grid_search(rows, plan.target, names, config.kind, plan.key, plan.folds, plan.seed, scaling="standard" if config.scaling else None)
        row = found.where("best").first()
        config = RegressionConfig(config.kind, row["alpha"], row["l1_ratio"] if row["l1_ratio"] is not None else config.l1_ratio, config.scaling)
    fitted = regression.fit(rows, plan.target, names, config)

    def figures(section: str, part: DataFrame) -> DataFrame:
        known = fitted.predict(part.where(F.col(plan.target).isNotNull() & ~F.isnan(F.col(plan.target).cast("double"))))
        wide = regression.regression_metrics(known, plan.target, "prediction", fitted.n_train, len(names))
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in wide.columns if c != "n"])
        return wide.select(F.lit(section).alias("section"), F.explode(cells).alias("_x")).select("section", "_x.*").where("value IS NOT NULL")

    coefficients = regression.coefficient_table(df, names, fitted.coefficients, fitted.intercept)
    facts = [("rows", "train", float(fitted.n_train)), ("parameters", "alpha", float(config.alpha)), ("parameters", "l1_ratio", float(config.l1_ratio))]
    folds = regression.cross_validate(rows, plan.target, names, plan.key, plan.folds, plan.seed, config)
    report = (
        spark.createDataFrame(facts, "section string, item string, value double")
        .unionByName(coefficients.select(F.lit("coefficient").alias("section"), F.col("feature").alias("item"), F.col("coefficient").alias("value")))
        .unionByName(regression.feature_importance(coefficients).select(
            F.lit("importance").alias("section"), F.col("feature").alias("item"), F.col("importance").alias("value")))
        .unionByName(figures("train", rows)).unionByName(figures("test", held))
        .unionByName(folds.select(F.lit("cross_validation").alias("section"), F.concat(F.lit("fold "), F.col("fold").cast("string")).alias("item"), F.col("r2").alias("value"))))
    return Trained(plan, fitted, report)


def predict_saved(spark: SparkSession, records: str, model_id: str, df: DataFrame) -> DataFrame:
    """Score a table with the newest active model of that id, loaded from its record."""
    row = registry.list_models(spark, records, model_id=model_id).select("artefact", "features").first()
    if row is None:
        raise ValueError(f"no active model {model_id}")
    return regression.predict(registry.load_model(row["artefact"]), df, list(row["features"]))


def residual_charts(df: DataFrame, residual: str, key: str, bins: int = 30) -> DataFrame:
    """The two pictures of residuals as numbers: ``chart`` (histogram or qq), ``x``, ``y``.

    histogram: the middle of each bin and its count. qq: the normal quantile and the residual of that rank.
    """
    from tablesmith.operators import charts

    h = charts.histogram(df, residual, bins)
    q = charts.qq_points(df.select(key, F.nanvl(F.col(residual).cast("double"), F.lit(None).cast("double")).alias(residual)), residual, key)
    return h.select(F.lit("histogram").alias("chart"), ((F.col("left_edge") + F.col("right_edge")) / 2).alias("x"), F.col("n").cast("double").alias("y")).unionByName(
        q.select(F.lit("qq").alias("chart"), F.col("theoretical").alias("x"), F.col("value").alias("y")))
