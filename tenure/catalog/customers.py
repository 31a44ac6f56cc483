"""Per-customer features and the feature matrix."""

from __future__ import annotations

from pyspark.sql import functions as F


from tenure.catalog import register
from tenure.catalog.views import labels, round_sql, rounded, sql
from tenure.operators.features import (
    TIER_ORDER,
    Behaviour,
    Demographics,
    Rfm,
    session_rollup,
    ticket_features,
)
from tenure.operators.pipeline import TARGETS, FeaturePipeline, Preprocessor
from tenure.plans.materialise import materialise
from tenure.sources import retail

GAP = retail.SESSION_GAP_HOURS * 3600
DIGITS = 6  # for scaled values


def digits(column: str) -> int:
    """Finer than the shortest exact half a mean can end in, coarser than summation order."""
    return {"monetary_std": 4, "monetary_total": 4, "monetary_mean": 6}.get(column.strip('"'), 9)


def tidy(df, columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits(c)))
    return df


def tidy_sql(columns) -> str:
    return ", ".join(f"round({c}, {digits(c)}) AS {c}" for c in columns)


RFM = [
    "recency_days",
    "frequency",
    "monetary_total",
    "monetary_mean",
    "monetary_std",
    "avg_items_per_order",
    "return_rate",
    "avg_discount",
    "n_categories",
]
DEVICES = ["desktop", "mobile", "tablet"]
PAGES = ["account", "category", "checkout", "error", "product"]
BEHAVIOUR = [
    "n_sessions",
    "avg_session_duration_s",
    "avg_pages_per_session",
    "cart_session_rate",
    *[f"device_{v}_pct" for v in DEVICES],
    *[f"page_{v}_pct" for v in PAGES],
]
TICKETS = [
    "n_tickets",
    "avg_sentiment",
    "min_sentiment",
    "pct_resolved",
    "avg_resolution_days",
    "n_topics",
]
GENDERS = ["F", "M", "Non-binary", "Unknown"]
CHANNELS = ["billboard", "email", "organic_search", "paid_search", "social_media"]
PEOPLE = [
    "age",
    "loyalty_tier_ordinal",
    *[f"gender_{v}" for v in GENDERS],
    *[f"channel_{v}" for v in CHANNELS],
]
MATRIX = PEOPLE + RFM + BEHAVIOUR + TICKETS


def _q(name: str) -> str:
    return f'"{name}"'


SESSIONS_SQL = """
    SELECT customer_id, session_id, sum(time_on_page_seconds) AS session_duration_s,
           count(session_id) AS pages_per_session,
           max(added_to_cart::INT)::DOUBLE AS added_to_cart_in_session
    FROM clickstream GROUP BY customer_id, session_id"""

BEHAVIOUR_SQL = f"""
    SELECT customer_id, n_sessions, avg_session_duration_s, avg_pages_per_session, cart_session_rate,
           {", ".join(_q(f"device_{v}_pct") for v in DEVICES)},
           {", ".join(_q(f"page_{v}_pct") for v in PAGES)}
    FROM (SELECT customer_id, count(*)::DOUBLE AS n_sessions,
                 avg(session_duration_s) AS avg_session_duration_s,
                 avg(pages_per_session) AS avg_pages_per_session,
                 avg(added_to_cart_in_session) AS cart_session_rate
          FROM ({SESSIONS_SQL}) GROUP BY customer_id)
    JOIN (SELECT customer_id,
          {", ".join(f"count(*) FILTER (WHERE device_type = '{v}') / nullif(count(device_type), 0) AS " + _q(f"device_{v}_pct") for v in DEVICES)},
          {", ".join(f"count(*) FILTER (WHERE page_type = '{v}') / nullif(count(page_type), 0) AS " + _q(f"page_{v}_pct") for v in PAGES)}
          FROM clickstream GROUP BY customer_id) USING (customer_id)"""

TICKETS_SQL = """
    SELECT customer_id, count(ticket_id)::DOUBLE AS n_tickets, avg(sentiment_score) AS avg_sentiment,
           min(sentiment_score) AS min_sentiment, avg(resolved::INT) AS pct_resolved,
           coalesce(avg(resolution_days), 0) AS avg_resolution_days,
           count(DISTINCT topic)::DOUBLE AS n_topics
    FROM support_tickets GROUP BY customer_id"""

PEOPLE_SQL = f"""
    SELECT customer_id, age::DOUBLE AS age,
           CASE loyalty_tier {" ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(TIER_ORDER))} END::DOUBLE
               AS loyalty_tier_ordinal,
           {", ".join(f"coalesce((gender = '{v}')::INT, 0)::DOUBLE AS " + _q(f"gender_{v}") for v in GENDERS)},
           {", ".join(f"coalesce((acquisition_channel = '{v}')::INT, 0)::DOUBLE AS " + _q(f"channel_{v}") for v in CHANNELS)}
    FROM customers"""

_QUOTED = [_q(c) for c in MATRIX]
MATRIX_SQL = f"""
    SELECT customer_id, {", ".join(c for c in _QUOTED if c != _q("n_tickets"))},
           coalesce(n_tickets, 0) AS n_tickets
    FROM (SELECT customer_id FROM labels)
    LEFT JOIN ({PEOPLE_SQL}) USING (customer_id)
    LEFT JOIN rfm USING (customer_id)
    LEFT JOIN ({BEHAVIOUR_SQL}) USING (customer_id)
    LEFT JOIN ({TICKETS_SQL}) USING (customer_id)"""
_MATRIX_VIEWS = ("labels", "customers", "rfm", "clickstream", "support_tickets")

IMPUTED_SQL = f"""
    SELECT customer_id, {", ".join(f"coalesce({c}, (SELECT median({c}) FROM raw_matrix)) AS {c}" for c in _QUOTED)}
    FROM raw_matrix"""
SCALED_SQL = f"""
    SELECT customer_id, {", ".join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}" for c in _QUOTED)}
    FROM imputed"""


def matrix_sql(body: str, *steps: str) -> str:
    """The body over raw_matrix and, where named, imputed and scaled."""
    extra = {"imputed": IMPUTED_SQL, "scaled": SCALED_SQL}
    head = sql("", *_MATRIX_VIEWS).rstrip() + f",\nraw_matrix AS ({MATRIX_SQL})"
    for s in steps:
        head += f",\n{s} AS ({extra[s]})"
    return head + "\n" + body


def sources(spark, sf_dir):
    return (
        retail.customers(spark, sf_dir),
        retail.transactions(spark, sf_dir),
        retail.clicks(spark, sf_dir),
        retail.support_tickets(spark, sf_dir),
        labels(spark, sf_dir),
    )


def feature_table(spark, sf_dir, scale: bool = True):
    """(feature rows with event and duration, names), extracted once and written."""
    pipe = FeaturePipeline(scale=scale, session_gap_seconds=GAP)
    out = pipe.fit_transform(*sources(spark, sf_dir))
    return materialise(out, "matrix"), pipe.feature_names


@register(
    "rfm_features",
    sql(f"SELECT customer_id, {tidy_sql(RFM)} FROM rfm", "rfm"),
)
def _rfm(spark, sf_dir):
    return tidy(Rfm().fit_transform(retail.transactions(spark, sf_dir)), RFM)


@register(
    "sessions",
    sql(
        f"SELECT customer_id, session_id, round(session_duration_s, 6) AS session_duration_s, "
        f"pages_per_session, added_to_cart_in_session FROM ({SESSIONS_SQL})",
        "clickstream",
    ),
)
def _sessions(spark, sf_dir):
    rolled = session_rollup(retail.clicks(spark, sf_dir), gap_seconds=GAP)
    return rounded(
        rolled.select(
            "customer_id",
            "session_id",
            "session_duration_s",
            "pages_per_session",
            "added_to_cart_in_session",
        ),
        6,
        "session_duration_s",
    )


@register(
    "behaviour_features",
    sql(
        f"SELECT customer_id, {tidy_sql([_q(c) for c in BEHAVIOUR])} FROM ({BEHAVIOUR_SQL})",
        "clickstream",
    ),
)
def _behaviour(spark, sf_dir):
    events = retail.clicks(spark, sf_dir)
    return tidy(Behaviour(gap_seconds=GAP).fit(events).transform(events), BEHAVIOUR)


@register(
    "session_events",
    sql("SELECT session_id, customer_id, event_timestamp, page_type FROM clickstream", "clickstream"),
)
def _session_events(spark, sf_dir):
    return retail.clickstream(spark, sf_dir).select(
        "session_id", "customer_id", "event_timestamp", "page_type"
    )


@register(
    "ticket_features",
    sql(f"SELECT customer_id, {tidy_sql(TICKETS)} FROM ({TICKETS_SQL})", "support_tickets"),
)
def _tickets(spark, sf_dir):
    return tidy(ticket_features(retail.support_tickets(spark, sf_dir)), TICKETS)


@register("customer_features", sql(PEOPLE_SQL, "customers"))
def _people(spark, sf_dir):
    people = retail.customers(spark, sf_dir)
    return Demographics().fit(people).transform(people)


@register(
    "customer_orders",
    sql(
        """SELECT customer_id, transaction_id, order_value
           FROM customers LEFT JOIN purchases USING (customer_id)""",
        "customers",
        "purchases",
    ),
)
def _customer_orders(spark, sf_dir):
    bought = retail.purchases(spark, sf_dir).select("customer_id", "transaction_id", "order_value")
    return retail.customers(spark, sf_dir).select("customer_id").join(bought, "customer_id", "left")


def _fitted(spark, sf_dir) -> FeaturePipeline:
    return FeaturePipeline(session_gap_seconds=GAP).fit_extractors(
        retail.customers(spark, sf_dir),
        retail.purchases(spark, sf_dir),
        retail.clicks(spark, sf_dir),
    )


@register(
    "feature_matrix_raw",
    matrix_sql(f"SELECT customer_id, {tidy_sql(_QUOTED)} FROM raw_matrix"),
)
def _matrix_raw(spark, sf_dir):
    raw = _fitted(spark, sf_dir).raw_features(*sources(spark, sf_dir))
    return tidy(raw.drop(*TARGETS), MATRIX)


def _raw_table(spark, sf_dir):
    return materialise(_fitted(spark, sf_dir).raw_features(*sources(spark, sf_dir)), "features")


@register(
    "feature_matrix_imputed",
    matrix_sql(f"SELECT customer_id, {tidy_sql(_QUOTED)} FROM imputed", "imputed"),
)
def _matrix_imputed(spark, sf_dir):
    raw = _raw_table(spark, sf_dir)
    return tidy(Preprocessor.fit(raw, scale=False).transform(raw).drop(*TARGETS), MATRIX)


@register(
    "feature_matrix_scaled",
    matrix_sql(
        f"SELECT customer_id, {round_sql(DIGITS, _QUOTED)} FROM scaled", "imputed", "scaled"
    ),
)
def _matrix_scaled(spark, sf_dir):
    raw = _raw_table(spark, sf_dir)
    return rounded(Preprocessor.fit(raw, scale=True).transform(raw).drop(*TARGETS), DIGITS, *MATRIX)


@register(
    "feature_matrix_targets",
    matrix_sql(
        f"SELECT customer_id, {round_sql(DIGITS, _QUOTED)}, event_observed AS event, "
        "duration_days AS duration FROM scaled JOIN labels USING (customer_id)",
        "imputed",
        "scaled",
    ),
)
def _matrix_targets(spark, sf_dir):
    table, names = feature_table(spark, sf_dir)
    return rounded(table, DIGITS, *names)
