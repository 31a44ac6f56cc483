"""Checks of how a fitted model behaves, as data jobs over its scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.plans.ordered import average_ranks, measure_splits
from tenure.plans.quantiles import exact_quantiles


def risk_by_outcome(scored: DataFrame) -> DataFrame:
    """Mean risk of churned and of censored customers."""
    return scored.groupBy("event").agg(
        F.avg("risk").alias("mean_risk"), F.count(F.lit(1)).alias("n")
    )


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties, one row."""
    pairs = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    pairs = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    cells = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    splits = measure_splits(pairs, ["x", "y"])
    ranked = cells.join(average_ranks(pairs, "x", "rx", splits["x"]), "x").join(
        average_ranks(pairs, "y", "ry", splits["y"]), "y"
    )
    # Weighted Pearson on distinct pairs: both means of average ranks are (N + 1) / 2.
    total = pairs.count()
    middle = F.lit((total + 1) / 2.0)
    dx, dy = F.col("rx") - middle, F.col("ry") - middle
    return ranked.agg(
        F.sum("n").alias("n"),
        F.try_divide(
            F.sum(F.col("n") * dx * dy),
            F.sqrt(F.sum(F.col("n") * dx * dx) * F.sum(F.col("n") * dy * dy)),
        ).alias("rho"),
    )


def quartile_means(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean of y where x lies at or below its first, and at or above its third quartile."""
    present = df.filter(F.col(x).isNotNull())
    low, high = exact_quantiles(present, [x], [0.25, 0.75])[x]
    value = F.col(x).cast("double")
    return present.agg(
        F.lit(low).cast("double").alias("q25"),
        F.lit(high).cast("double").alias("q75"),
        F.avg(F.when(value <= F.lit(low), F.col(y))).alias("mean_low"),
        F.avg(F.when(value >= F.lit(high), F.col(y))).alias("mean_high"),
    )


def median_by_risk_quartile(scored: DataFrame) -> DataFrame:
    """Mean of finite median times in the lowest and highest risk quartile."""
    finite = scored.filter(F.col("median_days") < F.lit(float("inf")))
    return quartile_means(finite, "risk", "median_days")


def curve_breaks(curves: DataFrame, key: str = "customer_id", tolerance: float = 1e-9) -> DataFrame:
    """Points of (key, t, surv) outside [0, 1] or above the point before them."""
    before = F.lag("surv").over(Window.partitionBy(key).orderBy("t"))
    rising = F.coalesce(F.col("surv") > F.col("_before") + tolerance, F.lit(False))
    outside = ~F.col("surv").between(0.0, 1.0)
    return curves.withColumn("_before", before).filter(rising | outside).drop("_before")


def changed_scores(a: DataFrame, b: DataFrame, columns: list[str], digits: int = 9) -> DataFrame:
    """Rows of `a` that `b` does not hold with the same rounded values; empty when invariant."""

    def rounded(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)

        def value(c: str) -> Column:
            return F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c)

        return df.select(*[value(c) for c in columns])

    return rounded(a).exceptAll(rounded(b))
