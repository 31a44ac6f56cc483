"""Column expectations, suites, summaries, integrity checks and the fault audit."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.operators.contracts import CHANNELS, DEVICES, GENDERS, PAGES, PAYMENTS, TIERS
from tenure.operators.labels import timestamp_literal
from tenure.plans.ordered import union_all
from tenure.plans.quantiles import exact_quantiles

log = logging.getLogger(__name__)

# Names of the check kinds, as summaries print them.
EXISTS = "expect_column_to_exist"
NOT_NULL = "expect_column_values_to_not_be_null"
UNIQUE = "expect_column_values_to_be_unique"
IN_SET = "expect_column_values_to_be_in_set"
BETWEEN = "expect_column_values_to_be_between"


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str
    values: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None
    mostly: float = 1.0

    def counts(self) -> tuple[Column, Column]:
        """(rows judged, rows that pass) as aggregates of one shared pass."""
        c = F.col(self.column)
        if self.kind == NOT_NULL:
            return F.count(F.lit(1)), F.count(c)
        if self.kind == IN_SET:
            return F.count(c), F.count_if(c.isin(*self.values))
        ok = c.isNotNull() & ~F.isnan(c.cast("double"))
        judged = F.count_if(ok)  # NaN is missing, like null
        if self.low is not None:
            ok = ok & (c >= F.lit(self.low))
        if self.high is not None:
            ok = ok & (c <= F.lit(self.high))
        return judged, F.count_if(ok)


SUITES: dict[str, list[Expectation]] = {
    "customers": [
        Expectation(EXISTS, "customer_id"),
        Expectation(NOT_NULL, "customer_id"),
        Expectation(UNIQUE, "customer_id"),
        Expectation(IN_SET, "acquisition_channel", tuple(CHANNELS)),
        Expectation(IN_SET, "gender", tuple(GENDERS)),
        Expectation(IN_SET, "loyalty_tier", tuple(TIERS)),
        Expectation(BETWEEN, "age", low=18, high=100, mostly=0.99),
    ],
    "transactions": [
        Expectation(EXISTS, "transaction_id"),
        Expectation(NOT_NULL, "transaction_id"),
        Expectation(IN_SET, "payment_method", tuple(PAYMENTS)),
        Expectation(BETWEEN, "order_value", low=0.0, mostly=0.95),
        Expectation(BETWEEN, "discount_applied", low=0.0, high=1.0, mostly=0.99),
        Expectation(BETWEEN, "num_items", low=1, mostly=0.98),
    ],
    "clickstream": [
        Expectation(EXISTS, "session_id"),
        Expectation(NOT_NULL, "session_id"),
        Expectation(IN_SET, "page_type", tuple(PAGES)),
        Expectation(IN_SET, "device_type", tuple(DEVICES)),
        Expectation(BETWEEN, "time_on_page_seconds", low=0.0, mostly=0.99),
    ],
    "support_tickets": [
        Expectation(EXISTS, "ticket_id"),
        Expectation(NOT_NULL, "ticket_id"),
        Expectation(NOT_NULL, "raw_text"),
        Expectation(BETWEEN, "sentiment_score", low=-1.0, high=1.0, mostly=0.99),
    ],
    "survival_labels": [
        Expectation(EXISTS, "customer_id"),
        Expectation(UNIQUE, "customer_id"),
        Expectation(BETWEEN, "duration_days", low=0.0),
        Expectation(BETWEEN, "total_orders", low=1),
        Expectation(BETWEEN, "total_revenue", low=0.0),
    ],
}

RESULT_SCHEMA = (
    "dataset string, position int, expectation string, column string, mostly double, "
    "n bigint, ok bigint, success boolean"
)


def _result_rows(
    source: DataFrame, name: str, items: list[tuple[int, Expectation]]
) -> DataFrame:
    """Turn the one-row aggregate `source` (n_i, ok_i) into one row per expectation."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(e.kind).alias("expectation"),
                F.lit(e.column).alias("column"),
                F.lit(float(e.mostly)).alias("mostly"),
                F.col(f"n_{i}").cast("bigint").alias("n"),
                F.col(f"ok_{i}").cast("bigint").alias("ok"),
            )
            for i, e in items
        ]
    )
    share = F.try_divide(F.col("ok").cast("double"), F.col("n").cast("double"))
    return (
        source.select(F.explode(rows).alias("r"))
        .select("r.*")
        .select(
            F.lit(name).alias("dataset"),
            "position",
            "expectation",
            "column",
            "mostly",
            "n",
            "ok",
            F.coalesce(share >= F.col("mostly"), F.lit(True)).alias("success"),
        )
    )


def run_suite(df: DataFrame, suite: list[Expectation], name: str) -> DataFrame:
    """One row per expectation.

    All null, set and range checks share one pass with map-side partials. Uniqueness needs a
    group count per column and is a second pass. A check on an absent column fails.
    """
    numbered = list(enumerate(suite))
    present = [(i, e) for i, e in numbered if e.column in df.columns]
    absent = [(i, e) for i, e in numbered if e.column not in df.columns]
    shared = [(i, e) for i, e in present if e.kind not in (EXISTS, UNIQUE)]
    parts = []
    fixed = [(i, e, 1, 1) for i, e in present if e.kind == EXISTS]
    fixed += [(i, e, 1, 0) for i, e in absent]
    if shared:
        aggregates = []
        for i, e in shared:
            judged, passed = e.counts()
            aggregates += [judged.alias(f"n_{i}"), passed.alias(f"ok_{i}")]
        # Metadata-only outcomes ride along as constants.
        source = df.agg(*aggregates).select(
            "*",
            *[F.lit(n).alias(f"n_{i}") for i, _, n, _ in fixed],
            *[F.lit(ok).alias(f"ok_{i}") for i, _, _, ok in fixed],
        )
        parts.append(_result_rows(source, name, shared + [(i, e) for i, e, _, _ in fixed]))
    elif fixed:
        one = df.sparkSession.range(1).select(
            *[F.lit(n).alias(f"n_{i}") for i, _, n, _ in fixed],
            *[F.lit(ok).alias(f"ok_{i}") for i, _, _, ok in fixed],
        )
        parts.append(_result_rows(one, name, [(i, e) for i, e, _, _ in fixed]))
    for i, e in present:
        if e.kind == UNIQUE:
            groups = df.filter(F.col(e.column).isNotNull()).groupBy(e.column).count()
            source = groups.agg(
                F.coalesce(F.sum("count"), F.lit(0)).alias(f"n_{i}"),
                F.count_if(F.col("count") == 1).alias(f"ok_{i}"),
            )
            parts.append(_result_rows(source, name, [(i, e)]))
    if not parts:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    return union_all(parts)


def validate_all(datasets: dict[str, DataFrame]) -> DataFrame:
    """Run the suite of every table given; a table that is absent is skipped with a warning."""
    parts = []
    for name, suite in SUITES.items():
        if datasets.get(name) is None:
            log.warning("dataset %s is absent, its suite is skipped", name)
            continue
        parts.append(run_suite(datasets[name], suite, name))
    if not parts:
        raise ValueError("no dataset to validate")
    return union_all(parts)


def summarise(results: DataFrame) -> DataFrame:
    """Per dataset: totals, success, pass rate, and "kind(column=c)" of every failure."""
    label = F.format_string("%s(column=%s)", "expectation", "column")
    return results.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_expectations"),
        F.count_if("success").alias("n_passed"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.min("success").alias("success"),
        F.coalesce(
            F.try_divide(
                F.count_if("success").cast("double"), F.count(F.lit(1)).cast("double")
            ),
            F.lit(1.0),
        ).alias("pass_rate"),
        F.sort_array(F.collect_list(F.when(~F.col("success"), label))).alias("failures"),
    )


# --- integrity -------------------------------------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key the parent does not hold. Parents are reduced first, so that a hot key is one row of the join."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


def coverage(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Share of the parent's keys that occur in the child."""
    seen = child.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_seen", F.lit(1))
    return (
        parent.select(key)
        .distinct()
        .join(seen, key, "left")
        .agg(F.count("_seen").alias("n_covered"), F.count(F.lit(1)).alias("n_total"))
        .withColumn(
            "coverage",
            F.try_divide(F.col("n_covered").cast("double"), F.col("n_total").cast("double")),
        )
    )


def label_coverage(labels: DataFrame, transactions: DataFrame) -> DataFrame:
    """Label rows against distinct buyers; both numbers must agree."""
    rows = labels.agg(F.count(F.lit(1)).alias("n_labels"), F.lit(0).alias("n_buyers"))
    buyers = transactions.agg(
        F.lit(0).alias("n_labels"), F.countDistinct("customer_id").alias("n_buyers")
    )
    return (
        rows.unionByName(buyers)
        .agg(F.sum("n_labels").alias("n_labels"), F.sum("n_buyers").alias("n_buyers"))
        .withColumn("complete", F.col("n_labels") == F.col("n_buyers"))
    )


def out_of_order(df: DataFrame, first: str, last: str) -> DataFrame:
    """Rows whose first date lies after the last."""
    return df.filter(F.col(first) > F.col(last))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of every non-null value."""
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    total = df.select(F.count(column).alias("total")).first()["total"]
    return counts.withColumn("share", F.col("n") / F.lit(float(max(total, 1))))


# --- fault audit -----------------------------------------------------------------------------

OUTLIER_FACTOR = 10.0
OUTLIER_QUANTILE = 0.99
# Keys and event dates are never counted as missing.
SKIP_MISSING = {
    "customer_id",
    "transaction_id",
    "session_id",
    "ticket_id",
    "event_timestamp",
    "registration_date",
}


def _first_matching(columns: Iterable[str], words: tuple[str, ...]) -> str | None:
    return next((c for c in columns if any(w in c for w in words)), None)


@dataclass(frozen=True)
class FaultAudit:
    """What is checked per table; unset columns are found by name as the fault kinds define."""

    key: str
    end: datetime | None = None
    ts_col: str | None = None
    amount_col: str | None = None
    outlier_cols: tuple[str, ...] | None = None
    skip: frozenset[str] = field(default_factory=lambda: frozenset(SKIP_MISSING))


def fault_report(df: DataFrame, name: str, audit: FaultAudit) -> DataFrame:
    """(dataset, fault, n) for missing cells, repeated keys, outliers, future dates, negatives.

    Outliers are values above 10 times the 99th percentile of their column, where that is positive: a multiple of zero or of
    a negative number is no fence. The fence is computed first, then all counts except duplicates share one pass.
    """
    fields = {f.name: f.dataType for f in df.schema.fields}
    nullable = [
        c
        for c, t in fields.items()
        if c not in audit.skip and isinstance(t, (T.StringType, T.NumericType))
    ]
    ts = audit.ts_col or _first_matching(fields, ("timestamp", "date"))
    amount = audit.amount_col or _first_matching(fields, ("value", "revenue", "amount"))
    numeric = audit.outlier_cols
    if numeric is None:
        numeric = tuple(c for c, t in fields.items() if isinstance(t, T.NumericType))
    fences = exact_quantiles(df, numeric, [OUTLIER_QUANTILE]) if numeric else {}

    zero = F.lit(0)
    missing = sum((F.count_if(F.col(c).isNull()) for c in nullable), zero)
    outliers = zero
    for c in numeric:
        fence = fences[c][0]
        if fence is not None and fence > 0:
            outliers = outliers + F.count_if(F.col(c) > F.lit(OUTLIER_FACTOR * fence))
    kind = dict(df.dtypes).get(ts)
    future = (
        F.count_if(F.col(ts) > timestamp_literal(audit.end, kind))
        if ts is not None and audit.end is not None and kind.startswith("timestamp")
        else zero
    )
    negative = F.count_if(F.col(amount) < 0) if amount is not None else zero
    counted = df.agg(
        missing.cast("bigint").alias("missing"),
        outliers.cast("bigint").alias("outliers"),
        future.cast("bigint").alias("future_dates"),
        negative.cast("bigint").alias("negative_amounts"),
    ).unpivot([], ["missing", "outliers", "future_dates", "negative_amounts"], "fault", "n")
    repeated = (
        df.filter(F.col(audit.key).isNotNull())
        .groupBy(audit.key)
        .count()
        .agg(
            F.lit("duplicates").alias("fault"),
            F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n"),
        )
    )
    return counted.unionByName(repeated).select(F.lit(name).alias("dataset"), "fault", "n")


def drop_repeats(df: DataFrame, key: str, order_by: list[str] | None = None) -> DataFrame:
    """One row per key, the first by `order_by` (all columns by default), kept whole. Rows without a key
    repeat nothing and all stay.

    `min_by` keeps one row per key map-side, so a key with very many copies is never sorted.
    """
    columns = df.columns
    order = [F.col(c) for c in (order_by or columns)]
    row = F.struct(*[F.col(c) for c in columns])
    tied = F.struct(*order, *[F.col(c) for c in columns if c not in (order_by or columns)])
    keyed = df.filter(F.col(key).isNotNull())
    firsts = keyed.groupBy(key).agg(F.min_by(row, tied).alias("_row")).select("_row.*")
    return firsts.unionByName(df.filter(F.col(key).isNull()))
