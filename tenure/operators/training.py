"""Cross-validation and final fits, with parameters and metrics kept as tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators.evaluate import (
    aggregate_folds,
    evaluate_folds,
    results_table,
    stratified_folds,
)
from tenure.operators.survival import DEFAULT_HORIZONS, SurvivalEstimator, SurvivalModel
from tenure.plans.materialise import materialise_by

RUN_SCHEMA = (
    "run_id string, parent_run_id string, name string, params map<string,string>, "
    "tags map<string,string>, started_at timestamp"
)


class RunLog:
    """Append-only Parquet tables `runs` and `metrics` under one folder, and the models of its runs under `models`."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def start(
        self, name: str, params: dict, tags: dict | None = None, parent: str | None = None
    ) -> str:
        run_id = uuid.uuid4().hex
        row = (
            run_id,
            parent,
            name,
            {k: str(v) for k, v in params.items()},
            {k: str(v) for k, v in (tags or {}).items()},
            datetime.now(timezone.utc).replace(tzinfo=None),
        )
        self.spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(
            f"{self.path}/runs"
        )
        return run_id

    def metrics(self, results: DataFrame, run_id: str, parent: str | None = None) -> None:
        results.select(
            F.lit(run_id).alias("run_id"),
            F.lit(parent).cast("string").alias("parent_run_id"),
            *results.columns,
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/metrics")

    def summary(self, results: DataFrame, run_id: str) -> None:
        """Mean and deviation over folds of every figure, as metrics of the run that the folds belong to."""
        each = aggregate_folds(results.filter(~F.col("metric").isin("n_train", "n_test"))).crossJoin(results.select("model").limit(1))
        kinds = [F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("mean", "std")]
        rows = each.select("model", "metric", "t", F.explode(F.array(*kinds)).alias("_x")).select(
            "model", F.lit(None).cast("int").alias("fold"), F.concat("_x.kind", F.lit("_"), "metric").alias("metric"), "t", "_x.value"
        )
        self.metrics(rows, run_id)

    def keep_model(self, model: SurvivalModel, run_id: str) -> str:
        path = f"{self.path}/models/{run_id}"
        model.save(path)
        return path

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs")

    def logged_metrics(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/metrics")


def cross_validate(
    estimator: SurvivalEstimator,
    df: DataFrame,
    features: Sequence[str],
    n_splits: int = 5,
    random_state: int = 42,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    runs: RunLog | None = None,
    key: str = "customer_id",
) -> DataFrame:
    """Fit on all folds but one and evaluate on that one; long table of every figure.

    The folded table is written once, partitioned by fold, so each side of every split is a
    partition-pruned read. An estimator with `fit_folds` fits the models of all folds in the same scans. With a
    run log, every fold's run keeps its figures and its model, and the run above them their means and deviations.
    """
    spark = df.sparkSession
    features = list(features)
    folded = stratified_folds(df.select(key, *features, "duration", "event"), n_splits, random_state, key)
    folded = materialise_by(folded, "fold", "folds")
    if hasattr(estimator, "fit_folds"):
        models = estimator.fit_folds(folded, features, n_splits)
    else:
        models = [estimator.fit(folded.filter(F.col("fold") != fold), features) for fold in range(n_splits)]
    results = evaluate_folds(models, folded, horizons)
    table = results_table(spark, results)
    if runs is not None:
        tags = {"model": estimator.name, "n_splits": n_splits, "n_samples": int(sum(r.value("n_test") for r in results)), "n_features": len(features)}
        parent = runs.start(f"{estimator.name}_cv{n_splits}", estimator.get_params(), tags)
        for fold, (model, result) in enumerate(zip(models, results)):
            run_id = runs.start(f"{estimator.name}_fold{fold}", estimator.get_params(), {"fold": fold}, parent)
            runs.metrics(results_table(spark, [result]), run_id, parent)
            runs.keep_model(model, run_id)
        runs.summary(table, parent)
    return table


def train_final(
    estimator: SurvivalEstimator,
    df: DataFrame,
    features: Sequence[str],
    model_path: str,
    runs: RunLog | None = None,
) -> str:
    """Fit on every row, save the model, return the run id."""
    model = estimator.fit(df, list(features))
    run_id = uuid.uuid4().hex
    if runs is not None:
        run_id = runs.start(
            f"{estimator.name}_final",
            {**estimator.get_params(), "n_samples": df.count(), "n_features": len(features)},
            {"training_mode": "final"},
        )
    model.version = run_id
    model.save(f"{model_path.rstrip('/')}/{run_id}")
    return run_id
