"""Views that present an order/event warehouse as the five logical customer tables.

Every view is lazy: columns a job does not use never leave the scan, and the line-item roll-up
is dropped from the plan by the optimizer when no line-item column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators.features import sessionise

SESSION_GAP_HOURS = 12

# How warehouse codes read as customer attributes.
CHANNELS = {
    "AUTOMOBILE": "organic_search",
    "BUILDING": "paid_search",
    "FURNITURE": "social_media",
    "HOUSEHOLD": "email",
    "MACHINERY": "billboard",
}
GENDERS = {"AFRICA": "M", "AMERICA": "F", "ASIA": "Non-binary", "EUROPE": "Unknown"}
PAYMENTS = {
    "1-URGENT": "credit_card",
    "2-HIGH": "debit_card",
    "3-MEDIUM": "paypal",
    "4-NOT SPECIFIED": "crypto",
    "5-LOW": "voucher",
}
PAGES = {
    "view": "product",
    "click": "category",
    "purchase": "checkout",
    "signup": "account",
    "error": "error",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _coded(col: Column, codes: dict[str, str]) -> Column:
    out = None
    for raw, name in codes.items():
        out = F.when(col == raw, name) if out is None else out.when(col == raw, name)
    return out


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation and region hold 25 and 5 rows at every scale, so both are broadcast."""
    places = table(spark, sf_dir, "nation").join(
        F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey")
    )
    balance = F.col("c_acctbal")
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").cast("string").alias("customer_id"),
            F.col("c_name").alias("first_name"),
            F.col("n_name").alias("last_name"),
            F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
            F.col("n_name").alias("country"),
            _coded(F.col("c_mktsegment"), CHANNELS).alias("acquisition_channel"),
            F.expr("TIMESTAMP_NTZ'1994-01-01 00:00:00' + make_dt_interval(c_nationkey)").alias(
                "registration_date"
            ),
            F.when(balance >= 0, F.floor(balance / 100).cast("int")).alias("age"),
            _coded(F.col("r_name"), GENDERS).alias("gender"),
            F.when(balance < 0, "None")
            .when(balance < 2500, "Bronze")
            .when(balance < 5000, "Silver")
            .when(balance < 7500, "Gold")
            .otherwise("Platinum")
            .alias("loyalty_tier"),
        )
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order log alone: all that labels need."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").alias("event_timestamp"),
        F.col("o_totalprice").alias("order_value"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; line items are rolled up before the join, so no order is multiplied."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_quantity").cast("int").alias("num_items"),
            F.max(F.col("l_returnflag") == "R").alias("is_returned"),
            F.max("l_discount").alias("discount_applied"),
        )
    )
    return (
        table(spark, sf_dir, "orders")
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.col("o_orderkey").cast("string").alias("transaction_id"),
            F.col("o_custkey").cast("string").alias("customer_id"),
            F.col("o_orderdate").alias("event_timestamp"),
            F.col("o_totalprice").alias("order_value"),
            "num_items",
            F.col("o_orderstatus").alias("product_category"),
            _coded(F.col("o_orderpriority"), PAYMENTS).alias("payment_method"),
            "is_returned",
            "discount_applied",
        )
    )


def _event_key(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as clickstream rows that carry no session yet."""
    return as_clicks(table(spark, sf_dir, "events"))


def as_clicks(events: DataFrame) -> DataFrame:
    k = F.col("_k")  # parsed once for each event
    return events.withColumn("_k", _event_key(F.col("props"))).select(
        F.col("user_id").cast("string").alias("customer_id"),
        F.col("ts").alias("event_timestamp"),
        _coded(F.col("event_type"), PAGES).alias("page_type"),
        F.col("value").alias("time_on_page_seconds"),
        F.when(k < 33, "desktop").when(k < 66, "mobile").when(k < 95, "tablet").alias("device_type"),
        (F.col("event_type") == "purchase").alias("added_to_cart"),
        F.when(F.col("event_type") == "view", F.col("props")).alias("search_query"),
    )


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionise(clicks(spark, sf_dir), SESSION_GAP_HOURS * 3600)


def support_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("_k")  # parsed once for each event
    return (
        table(spark, sf_dir, "events")
        .filter(F.col("event_type") == "error")
        .withColumn("_k", _event_key(F.col("props")))
        .select(
            F.col("event_id").cast("string").alias("ticket_id"),
            F.col("user_id").cast("string").alias("customer_id"),
            F.col("ts").alias("created_at"),
            F.concat(F.lit("topic_"), F.floor(k / 13).cast("string")).alias("topic"),
            F.col("props").alias("raw_text"),
            ((F.col("value") - 50) / 100).alias("sentiment_score"),
            (k >= 40).alias("resolved"),
            F.when(k >= 40, F.col("value") / 10).alias("resolution_days"),
        )
    )


def uuid_form(col: Column) -> Column:
    """A UUID-shaped key, so that the identifier rule sees valid values."""
    h = F.md5(col)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.substring(h, 13, 4),
        F.substring(h, 17, 4),
        F.substring(h, 21, 12),
    )
