"""Per-customer features: purchases, sessions, tickets, demographics.

Each extractor is one aggregation (sessions: two, the second over the first), so a customer who
holds a large part of the rows is reduced map-side before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.columns import epoch_seconds, one_hot, ordinal, whole_days
from tenure.operators.labels import timestamp_literal, window_end

# Tiers from lowest to highest.
TIER_ORDER = ["Bronze", "Silver", "Gold", "Platinum"]


def _with_block(clicks: DataFrame, gap_seconds: int) -> DataFrame:
    """Add `_block`, the event time in steps of gap/12: events of one customer inside one block
    can never belong to different sessions."""
    seconds = epoch_seconds(F.col("event_timestamp"), dict(clicks.dtypes)["event_timestamp"])
    return clicks.withColumn("_block", F.floor(seconds / max(1, gap_seconds // 12)))


def _number_sessions(blocks: DataFrame, gap_seconds: int) -> DataFrame:
    """Replace the extents `_from`, `_to` of (customer, block) rows by `session_id`.

    A customer's session ends after a silence longer than `gap_seconds`, as in Spark's session
    windows. The window holds at most one row per block of calendar time, however many events the
    customer has.
    """
    by_time = Window.partitionBy("customer_id").orderBy("_block")
    silence = F.col("_from") - F.lag("_to").over(by_time)
    opens = F.when(silence <= F.make_dt_interval(secs=F.lit(gap_seconds)), 0).otherwise(1)
    number = F.sum("_opens").over(by_time).cast("string")
    return (
        blocks.withColumn("_opens", opens)
        .withColumn("session_id", F.concat_ws("-", "customer_id", number))
        .drop("_opens", "_from", "_to")
    )


_EXTENT = (F.min, "_from"), (F.max, "_to")


def sessionise(clicks: DataFrame, gap_seconds: int) -> DataFrame:
    """Add `session_id` to every event, null where it has no customer or no time; for roll-ups alone
    `session_rollup` needs no such join."""
    events = _with_block(clicks, gap_seconds)
    blocks = events.groupBy("customer_id", "_block").agg(
        *[fold("event_timestamp").alias(name) for fold, name in _EXTENT]
    )
    numbered = _number_sessions(blocks, gap_seconds)
    return events.join(numbered, ["customer_id", "_block"], "left").select("session_id", *clicks.columns)


@dataclass(frozen=True)
class Rfm:
    """Recency, frequency and monetary features; the reference date is learned by `fit`."""

    reference_date: datetime | None = None
    fitted_date: datetime | None = None

    def fit(self, transactions: DataFrame) -> "Rfm":
        return Rfm(self.reference_date, self.reference_date or window_end(transactions))

    def transform(self, transactions: DataFrame) -> DataFrame:
        if self.fitted_date is None:
            raise RuntimeError("fit() must run before transform()")
        kind = dict(transactions.dtypes)["event_timestamp"]
        return (
            transactions.filter(F.col("customer_id").isNotNull())
            .groupBy("customer_id")
            .agg(
                whole_days(
                    F.max("event_timestamp"), timestamp_literal(self.fitted_date, kind)
                ).cast("double").alias("recency_days"),
                F.count("transaction_id").cast("double").alias("frequency"),
                F.coalesce(F.sum("order_value"), F.lit(0.0)).alias("monetary_total"),
                F.avg("order_value").alias("monetary_mean"),
                F.coalesce(F.stddev_samp("order_value"), F.lit(0.0)).alias("monetary_std"),
                F.avg("num_items").alias("avg_items_per_order"),
                F.avg(F.col("is_returned").cast("double")).alias("return_rate"),
                F.avg("discount_applied").alias("avg_discount"),
                F.countDistinct("product_category").cast("double").alias("n_categories"),
            )
        )

    def fit_transform(self, transactions: DataFrame) -> DataFrame:
        return self.fit(transactions).transform(transactions)


MAX_LEVELS = 1000  # a categorical column with more values is not one-hot material


def levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per categorical column, learned once and then frozen.

    One scan for all columns; what is fetched is bounded, and a column beyond the bound raises.
    """
    if not cols:
        return {}
    # Rows of all columns are made distinct first: an event is then not stacked once for each column.
    stacked = df.select(*cols).distinct().select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])
        ).alias("_x")
    ).select("_x.*")
    distinct = stacked.filter(F.col("value").isNotNull()).distinct()
    out: dict[str, list[str]] = {c: [] for c in cols}
    for r in distinct.take(MAX_LEVELS * len(cols) + 1):
        out[r["column"]].append(r["value"])
    for c, seen in out.items():
        if len(seen) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
    return {c: sorted(seen) for c, seen in out.items()}


def session_rollup(
    clickstream: DataFrame,
    devices: Sequence[str] = (),
    pages: Sequence[str] = (),
    gap_seconds: int | None = None,
) -> DataFrame:
    """Per (customer, session): time on page, pages, any cart, and counts per device and page.

    Events without a `session_id` column are cut into sessions by silences of `gap_seconds`.
    They are then summed per (customer, block of time) first and only those sums are ordered and
    joined into sessions: no event is ever shuffled.
    """
    known = clickstream.filter(F.col("customer_id").isNotNull())
    counts = {f"_device_{v}": F.col("device_type") == v for v in devices}
    counts |= {f"_page_{v}": F.col("page_type") == v for v in pages}
    first = [
        F.coalesce(F.sum("time_on_page_seconds"), F.lit(0.0)).alias("session_duration_s"),
        F.max(F.col("added_to_cart").cast("double")).alias("added_to_cart_in_session"),
        F.count("device_type").alias("_device"),
        F.count("page_type").alias("_page"),
        *[F.count_if(c).alias(n) for n, c in counts.items()],
    ]
    if "session_id" in clickstream.columns:
        return known.groupBy("customer_id", "session_id").agg(
            F.count("session_id").alias("pages_per_session"), *first
        )
    if gap_seconds is None:
        raise ValueError("events carry no session_id: name the gap that ends a session")
    blocks = (
        _with_block(known, gap_seconds)
        .groupBy("customer_id", "_block")
        .agg(
            *[fold("event_timestamp").alias(name) for fold, name in _EXTENT],
            F.count(F.lit(1)).alias("pages_per_session"),
            *first,
        )
    )
    sums = ["pages_per_session", "session_duration_s", "_device", "_page", *counts]
    return (
        _number_sessions(blocks, gap_seconds)
        .groupBy("customer_id", "session_id")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.max("added_to_cart_in_session").alias("added_to_cart_in_session"),
        )
    )


@dataclass(frozen=True)
class Behaviour:
    """Session and engagement features; device and page levels are frozen by `fit`."""

    devices: list[str] | None = None
    pages: list[str] | None = None
    gap_seconds: int | None = None

    def fit(self, clickstream: DataFrame) -> "Behaviour":
        """Learns whichever levels were not given."""
        given = {"device_type": self.devices, "page_type": self.pages}
        seen = given | levels(clickstream, [c for c, v in given.items() if v is None])
        return Behaviour(seen["device_type"], seen["page_type"], self.gap_seconds)

    def transform(self, clickstream: DataFrame) -> DataFrame:
        """Shares come out of the same roll-up as the session means, so one scan serves both."""
        if self.devices is None or self.pages is None:
            raise RuntimeError("fit() must run before transform()")
        real = F.col("session_id").isNotNull()
        sessions = session_rollup(clickstream, self.devices, self.pages, self.gap_seconds)

        def share(kind: str, level: str):
            part, whole = F.sum(f"_{kind}_{level}"), F.sum(f"_{kind}")
            return F.try_divide(part.cast("double"), whole.cast("double")).alias(
                f"{kind}_{level}_pct"
            )

        return (
            sessions.groupBy("customer_id")
            .agg(
                F.count("session_id").cast("double").alias("n_sessions"),
                F.avg(F.when(real, F.col("session_duration_s"))).alias("avg_session_duration_s"),
                F.avg(F.when(real, F.col("pages_per_session"))).alias("avg_pages_per_session"),
                F.avg(F.when(real, F.col("added_to_cart_in_session"))).alias("cart_session_rate"),
                *[share("device", v) for v in self.devices],
                *[share("page", v) for v in self.pages],
            )
            .filter(F.col("n_sessions") > 0)
        )


def ticket_features(tickets: DataFrame) -> DataFrame:
    return (
        tickets.filter(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(
            F.count("ticket_id").cast("double").alias("n_tickets"),
            F.avg("sentiment_score").alias("avg_sentiment"),
            F.min("sentiment_score").alias("min_sentiment"),
            F.avg(F.col("resolved").cast("double")).alias("pct_resolved"),
            F.coalesce(F.avg("resolution_days"), F.lit(0.0)).alias("avg_resolution_days"),
            F.countDistinct("topic").cast("double").alias("n_topics"),
        )
    )


@dataclass(frozen=True)
class Demographics:
    """Age, ordinal tier and one-hot gender and channel; levels are frozen by `fit`."""

    tier_order: list[str] = field(default_factory=lambda: list(TIER_ORDER))
    genders: list[str] | None = None
    channels: list[str] | None = None

    def fit(self, customers: DataFrame) -> "Demographics":
        """Learns whichever levels were not given."""
        given = {"gender": self.genders, "acquisition_channel": self.channels}
        seen = given | levels(customers, [c for c, v in given.items() if v is None])
        return Demographics(self.tier_order, seen["gender"], seen["acquisition_channel"])

    def transform(self, customers: DataFrame) -> DataFrame:
        if self.genders is None or self.channels is None:
            raise RuntimeError("fit() must run before transform()")
        gender, channel = F.col("gender"), F.col("acquisition_channel")
        return customers.select(
            "customer_id",
            F.col("age").cast("double").alias("age"),
            ordinal(F.col("loyalty_tier"), self.tier_order).alias("loyalty_tier_ordinal"),
            *[one_hot(gender, v).alias(f"gender_{v}") for v in self.genders],
            *[one_hot(channel, v).alias(f"channel_{v}") for v in self.channels],
        )
