"""Batch scoring of whole customer tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tenure.operators.survival import DEFAULT_HORIZONS, SurvivalModel
from tenure.plans.columns import quoted


def feature_input(df: DataFrame, features: Sequence[str], column: str | None = None) -> DataFrame:
    """Model features as columns, taken from a map column when one is named."""
    if column is None:
        return df
    return df.select(
        "customer_id",
        *[F.try_element_at(F.col(column), F.lit(f)).cast("double").alias(f) for f in features],
    )


def lacking(features: Sequence[str]) -> Column:
    """The names of the features that a row lacks, or that are not finite."""
    number = lambda f: F.col(quoted(f)).cast("double")
    bad = lambda f: number(f).isNull() | F.isnan(number(f)) | (F.abs(number(f)) == float("inf"))
    return F.array_compact(F.array(*[F.when(bad(f), F.lit(f)) for f in features]))


def split_scorable(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every feature present and finite, the others with the names of what is missing or not finite)."""
    marked = df.withColumn("missing", lacking(features))
    good = marked.filter(F.size("missing") == 0).drop("missing")
    return good, marked.filter(F.size("missing") > 0)


def score(
    df: DataFrame,
    model: SurvivalModel,
    horizons: Sequence[int] = DEFAULT_HORIZONS,
    features_map: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(scores, rejected rows).

    Scores: customer_id, risk_score, median_survival_days, survival_curve{time_days,
    probabilities}, model_version. Risk and curve are projections; the median is a lookup in the
    broadcast baseline, so scoring does not shuffle the customers.
    """
    good, bad = split_scorable(feature_input(df, model.features, features_map), model.features)
    scored = model.median(good)
    curve = F.struct(
        F.array(*[F.lit(int(h)) for h in horizons]).alias("time_days"),
        model.survival_array(horizons).alias("probabilities"),
    )
    return (
        scored.select(
            "customer_id",
            F.col("risk").alias("risk_score"),
            F.col("median_days").alias("median_survival_days"),
            curve.alias("survival_curve"),
            F.lit(model.version).alias("model_version"),
        ),
        bad,
    )


def counted(df: DataFrame, model: SurvivalModel, features_map: str | None = None) -> tuple[DataFrame, Observation]:
    """The input with counters `total` and `failed` filled as a side effect of the next action."""
    wide = feature_input(df, model.features, features_map)
    seen = Observation("scoring")
    failed = F.count_if(F.size(lacking(model.features)) > 0)
    return wide.observe(seen, F.count(F.lit(1)).alias("total"), failed.alias("failed")), seen
