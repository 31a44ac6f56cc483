"""The logical tables and shared steps, as SQL for the oracle and as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.operators.features import Rfm
from tenure.operators.labels import survival_labels, window_end
from tenure.operators.survival import linear_risk
from tenure.sources import retail

HORIZONS = (730, 1095, 1460, 1825, 2190)

# A fixed linear score, so that scoring and metrics are checked apart from the solver.
RISK_FEATURES = ("recency_days", "frequency", "n_categories")
RISK_COEF = (0.002, -0.05, 0.1)


def _case(column: str, codes: dict[str, str]) -> str:
    arms = " ".join(f"WHEN {column} = '{k}' THEN '{v}'" for k, v in codes.items())
    return f"CASE {arms} END"


_RISK = " + ".join(f"{w}::DOUBLE * {f}" for f, w in zip(RISK_FEATURES, RISK_COEF))

# name -> (views it reads, SQL)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "customers": (
        (),
        f"""
        SELECT c_custkey::VARCHAR AS customer_id, c_name AS first_name, n_name AS last_name,
               lower(c_name) || '@example.com' AS email, n_name AS country,
               {_case('c_mktsegment', retail.CHANNELS)} AS acquisition_channel,
               TIMESTAMP '1994-01-01' + to_days(c_nationkey) AS registration_date,
               CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 100)::INT END AS age,
               {_case('r_name', retail.GENDERS)} AS gender,
               CASE WHEN c_acctbal < 0 THEN 'None' WHEN c_acctbal < 2500 THEN 'Bronze'
                    WHEN c_acctbal < 5000 THEN 'Silver' WHEN c_acctbal < 7500 THEN 'Gold'
                    ELSE 'Platinum' END AS loyalty_tier
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
             LEFT JOIN region ON n_regionkey = r_regionkey""",
    ),
    "purchases": (
        (),
        """
        SELECT o_orderkey::VARCHAR AS transaction_id, o_custkey::VARCHAR AS customer_id,
               o_orderdate AS event_timestamp, o_totalprice AS order_value FROM orders""",
    ),
    "transactions": (
        (),
        f"""
        SELECT o_orderkey::VARCHAR AS transaction_id, o_custkey::VARCHAR AS customer_id,
               o_orderdate AS event_timestamp, o_totalprice AS order_value, num_items,
               o_orderstatus AS product_category,
               {_case('o_orderpriority', retail.PAYMENTS)} AS payment_method,
               is_returned, discount_applied
        FROM orders LEFT JOIN (
            SELECT l_orderkey, sum(l_quantity)::INT AS num_items,
                   bool_or(l_returnflag = 'R') AS is_returned, max(l_discount) AS discount_applied
            FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey""",
    ),
    "clickstream": (
        (),
        f"""
        SELECT user_id::VARCHAR || '-' || session_no AS session_id,
               user_id::VARCHAR AS customer_id, ts AS event_timestamp,
               {_case('event_type', retail.PAGES)} AS page_type, value AS time_on_page_seconds,
               CASE WHEN k < 33 THEN 'desktop' WHEN k < 66 THEN 'mobile' WHEN k < 95 THEN 'tablet' END
                   AS device_type,
               event_type = 'purchase' AS added_to_cart,
               CASE WHEN event_type = 'view' THEN props END AS search_query
        FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session_no,
                     (props->>'k')::INT AS k
              FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                                        <= INTERVAL {retail.SESSION_GAP_HOURS} HOUR
                                   THEN 0 ELSE 1 END AS opens FROM events))""",
    ),
    "support_tickets": (
        (),
        """
        SELECT event_id::VARCHAR AS ticket_id, user_id::VARCHAR AS customer_id, ts AS created_at,
               'topic_' || floor(k / 13)::BIGINT AS topic, props AS raw_text,
               (value - 50) / 100 AS sentiment_score, k >= 40 AS resolved,
               CASE WHEN k >= 40 THEN value / 10 END AS resolution_days
        FROM (SELECT *, (props->>'k')::INT AS k FROM events WHERE event_type = 'error')""",
    ),
    "labels": (
        ("purchases",),
        """
        SELECT customer_id, first_purchase_date, last_purchase_date,
               greatest(0, floor((epoch_us(CASE WHEN churned THEN churn_date ELSE end_at END)
                                  - epoch_us(first_purchase_date)) / 86400000000))::DOUBLE
                   AS duration_days,
               churned AS event_observed, total_orders, round(revenue, 2) AS total_revenue
        FROM (SELECT *, last_purchase_date + INTERVAL 90 DAY AS churn_date,
                     last_purchase_date + INTERVAL 90 DAY <= end_at AS churned
              FROM (SELECT customer_id, min(event_timestamp) AS first_purchase_date,
                           max(event_timestamp) AS last_purchase_date,
                           count(transaction_id) AS total_orders, sum(order_value) AS revenue
                    FROM purchases GROUP BY customer_id),
                   (SELECT max(event_timestamp) AS end_at FROM purchases))""",
    ),
    "rfm": (
        ("transactions",),
        """
        SELECT customer_id,
               floor((max(epoch_us(end_at)) - epoch_us(max(event_timestamp))) / 86400000000)::DOUBLE
                   AS recency_days,
               count(transaction_id)::DOUBLE AS frequency, sum(order_value) AS monetary_total,
               avg(order_value) AS monetary_mean,
               coalesce(stddev_samp(order_value), 0) AS monetary_std,
               avg(num_items) AS avg_items_per_order, avg(is_returned::INT) AS return_rate,
               avg(discount_applied) AS avg_discount,
               count(DISTINCT product_category)::DOUBLE AS n_categories
        FROM transactions, (SELECT max(event_timestamp) AS end_at FROM transactions)
        GROUP BY customer_id""",
    ),
    "scored": (
        ("labels", "rfm"),
        f"""
        SELECT customer_id, event_observed AS event, duration_days AS duration, recency_days,
               frequency, n_categories, {_RISK} AS risk
        FROM labels JOIN rfm USING (customer_id)""",
    ),
    "baseline": (
        ("scored",),
        """
        SELECT t, sum(d / s0) OVER (ORDER BY t) AS hazard
        FROM (SELECT duration AS t, sum(event::INT) AS d,
                     sum(sum(exp(risk))) OVER (ORDER BY duration DESC) AS s0
              FROM scored GROUP BY duration)""",
    ),
    "horizons": (
        (),
        "SELECT unnest([" + ", ".join(f"{h}" for h in HORIZONS) + "]) AS h",
    ),
    "km": (
        ("scored",),
        """
        SELECT t, product(CASE WHEN at_risk - d > 0 THEN 1 - c / (at_risk - d) ELSE 1 END)
                  OVER (ORDER BY t) AS g
        FROM (SELECT duration AS t, sum(event::INT) AS d, sum((NOT event)::INT) AS c,
                     sum(count(*)) OVER (ORDER BY duration DESC) AS at_risk
              FROM scored GROUP BY duration)""",
    ),
    "censoring_at": (
        ("km", "horizons"),
        """
        SELECT h, coalesce((SELECT min(g) FROM km WHERE t <= h), 1.0) AS gh,
               coalesce((SELECT max(hazard) FROM baseline WHERE t <= h), 0.0) AS hazard
        FROM horizons""",
    ),
    "weighted": (
        ("scored", "km"),
        """
        SELECT scored.*, CASE WHEN g > 0 THEN 1 / g ELSE 0 END AS inv_g
        FROM scored JOIN km ON duration = t""",
    ),
    "brier": (
        ("weighted", "baseline", "censoring_at"),
        """
        SELECT h AS t, avg(CASE WHEN duration <= h AND event THEN s * s * inv_g
                                WHEN duration > h AND gh > 0 THEN (1 - s) * (1 - s) / gh
                                ELSE 0 END) AS brier
        FROM (SELECT *, exp(-hazard * exp(risk)) AS s FROM weighted, censoring_at)
        GROUP BY h""",
    ),
}


def sql(body: str, *views: str) -> str:
    """The query over the named views, with everything they read, as one WITH statement."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for needed in VIEWS[name][0]:
            visit(needed)
        order.append(name)

    for v in views:
        visit(v)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in order) + "\n" + body


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return reduce(lambda d, c: d.withColumn(c, F.round(c, digits)), columns, df)


def round_sql(digits: int, columns: Sequence[str]) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    bought = retail.purchases(spark, sf_dir)
    return survival_labels(bought, window_end(bought))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer_id, event, duration, the fixed score's features and `risk`."""
    bought = retail.transactions(spark, sf_dir)
    end = window_end(bought)
    outcome = survival_labels(bought, end).select(
        "customer_id",
        F.col("event_observed").alias("event"),
        F.col("duration_days").alias("duration"),
    )
    features = Rfm(end).fit(bought).transform(bought).select("customer_id", *RISK_FEATURES)
    return outcome.join(features, "customer_id").withColumn(
        "risk", linear_risk(RISK_FEATURES, RISK_COEF)
    )
