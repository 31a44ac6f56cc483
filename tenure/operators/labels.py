"""Survival labels from a purchase log."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.functions.columns import add_days, whole_days
from tenure.plans.quantiles import exact_quantiles

CHURN_THRESHOLD_DAYS = 90


def window_end(transactions: DataFrame, ts: str = "event_timestamp") -> datetime:
    """Latest timestamp in the log, the default end of the observation window."""
    return transactions.agg(F.max(ts)).first()[0]


def timestamp_literal(value: datetime, like: str) -> Column:
    """Literal of the same timestamp type as the column it is compared with."""
    text = value.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(value, datetime) else str(value)
    return F.lit(text).cast(like)


def survival_labels(
    transactions: DataFrame,
    end: datetime,
    threshold_days: int = CHURN_THRESHOLD_DAYS,
) -> DataFrame:
    """One row per customer: churned when the last purchase lies `threshold_days` before `end`.

    A single aggregation with map-side partials; the rule itself is a projection.
    """
    kind = dict(transactions.dtypes)["event_timestamp"]
    end_at = timestamp_literal(end, kind)
    first, last = F.col("first_purchase_date"), F.col("last_purchase_date")
    churn_date = add_days(last, threshold_days)
    churned = churn_date <= end_at
    end_point = F.when(churned, churn_date).otherwise(end_at)
    return (
        transactions.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.min("event_timestamp").alias("first_purchase_date"),
            F.max("event_timestamp").alias("last_purchase_date"),
            F.count("transaction_id").alias("total_orders"),
            F.coalesce(F.sum("order_value"), F.lit(0.0)).alias("revenue"),
        )
        .select(
            "customer_id",
            "first_purchase_date",
            "last_purchase_date",
            F.greatest(F.lit(0), whole_days(first, end_point)).cast("double").alias("duration_days"),
            churned.alias("event_observed"),
            "total_orders",
            F.round("revenue", 2).alias("total_revenue"),
        )
    )


def cohort_summary(labels: DataFrame) -> DataFrame:
    """Churn rate, median duration and median revenue of a materialised label table."""
    medians = exact_quantiles(labels, ["duration_days", "total_revenue"], [0.5])
    return labels.agg(
        F.count(F.lit(1)).alias("n_customers"),
        F.avg(F.col("event_observed").cast("double")).alias("churn_rate"),
    ).select(
        "*",
        F.lit(medians["duration_days"][0]).cast("double").alias("median_duration"),
        F.lit(medians["total_revenue"][0]).cast("double").alias("median_revenue"),
    )


def churned_identity_breaks(
    labels: DataFrame, threshold_days: int = CHURN_THRESHOLD_DAYS
) -> DataFrame:
    """Churned rows whose duration is not (last - first) + threshold; empty when consistent."""
    spent = whole_days(F.col("first_purchase_date"), F.col("last_purchase_date"))
    return labels.filter(
        F.col("event_observed") & (F.col("duration_days") != spent + threshold_days)
    )


def signed_duration(event: Column, duration: Column) -> Column:
    """+duration when the event was observed, -duration when censored."""
    return F.when(event, duration).otherwise(-duration)


def with_targets(features: DataFrame, labels: DataFrame) -> DataFrame:
    """Put (event, duration) in the row of each customer; a customer without label raises."""
    target = labels.select(
        "customer_id",
        F.col("event_observed").cast("boolean").alias("event"),
        F.col("duration_days").cast("double").alias("duration"),
    )
    missing = features.join(target, "customer_id", "left_anti").select("customer_id").take(1)
    if missing:
        raise KeyError(f"no survival label for customer {missing[0][0]!r}")
    return features.join(target, "customer_id")


def dataset_summary(datasets: dict[str, DataFrame]) -> DataFrame:
    """Rows and columns per table."""
    from tenure.plans.ordered import union_all

    return union_all(
        [
            df.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("dataset"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
            )
            for name, df in datasets.items()
        ]
    )
