"""Labels, contracts, expectations, integrity and faults."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenure.catalog import register
from tenure.catalog.views import labels, rounded, sql
from tenure.operators.contracts import CONTRACTS, Contract, apply_contract, violation_counts
from tenure.operators.labels import (
    churned_identity_breaks,
    cohort_summary,
    dataset_summary,
    signed_duration,
    with_targets,
)
from tenure.operators.quality import (
    IN_SET,
    NOT_NULL,
    SUITES,
    UNIQUE,
    EXISTS,
    FaultAudit,
    coverage,
    drop_repeats,
    fault_report,
    label_coverage,
    orphans,
    out_of_order,
    run_suite,
    summarise,
    validate_all,
    value_shares,
)
from tenure.plans.materialise import materialise
from tenure.sources import retail
from tenure.sources.io import read_table

_SOURCES = {
    "customers": retail.customers,
    "transactions": retail.transactions,
    "clickstream": retail.clickstream,
    "support_tickets": retail.support_tickets,
    "survival_labels": labels,
}
_VIEW_OF = {n: n for n in _SOURCES} | {"survival_labels": "labels"}


# --- labels -------------------------------------------------------------------------------------


@register("survival_labels", sql("SELECT * FROM labels", "labels"))
def _survival_labels(spark, sf_dir):
    return labels(spark, sf_dir)


@register(
    "cohort_summary",
    sql(
        """SELECT count(*) AS n_customers, round(avg(event_observed::INT), 6) AS churn_rate,
                  round(median(duration_days), 6) AS median_duration,
                  round(median(total_revenue), 4) AS median_revenue FROM labels""",
        "labels",
    ),
)
def _cohort_summary(spark, sf_dir):
    out = cohort_summary(materialise(labels(spark, sf_dir), "labels"))
    return rounded(rounded(out, 6, "churn_rate", "median_duration"), 4, "median_revenue")


@register(
    "dataset_summary",
    sql(
        """SELECT 'customers' AS dataset, count(*) AS n_rows, 10 AS n_columns FROM customers
           UNION ALL SELECT 'transactions', count(*), 9 FROM transactions
           UNION ALL SELECT 'clickstream', count(*), 8 FROM clickstream
           UNION ALL SELECT 'support_tickets', count(*), 8 FROM support_tickets
           UNION ALL SELECT 'survival_labels', count(*), 7 FROM labels""",
        "customers",
        "transactions",
        "clickstream",
        "support_tickets",
        "labels",
    ),
)
def _dataset_summary(spark, sf_dir):
    return dataset_summary({n: f(spark, sf_dir) for n, f in _SOURCES.items()})


@register(
    "parquet_scan",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
       WHERE o_orderdate >= TIMESTAMP '2000-01-01'""",
)
def _parquet_scan(spark, sf_dir):
    return (
        read_table(spark, f"{sf_dir}/orders.parquet")
        .filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz"))
        .select("o_orderkey", "o_custkey", "o_totalprice")
    )


@register(
    "signed_duration",
    sql(
        """SELECT customer_id, CASE WHEN event_observed THEN duration_days ELSE -duration_days END
                  AS signed_duration FROM labels""",
        "labels",
    ),
)
def _signed_duration(spark, sf_dir):
    return labels(spark, sf_dir).select(
        "customer_id",
        signed_duration(F.col("event_observed"), F.col("duration_days")).alias("signed_duration"),
    )


@register(
    "churned_identity",
    sql(
        """SELECT count(*) AS n_breaks FROM labels WHERE event_observed AND duration_days <>
             floor((epoch_us(last_purchase_date) - epoch_us(first_purchase_date)) / 86400000000) + 90""",
        "labels",
    ),
)
def _churned_identity(spark, sf_dir):
    return churned_identity_breaks(labels(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n_breaks"))


@register(
    "target_alignment",
    sql(
        """SELECT transaction_id, customer_id, event_observed AS event, duration_days AS duration
           FROM purchases JOIN labels USING (customer_id)""",
        "purchases",
        "labels",
    ),
)
def _target_alignment(spark, sf_dir):
    bought = retail.purchases(spark, sf_dir).select("transaction_id", "customer_id")
    return with_targets(bought, labels(spark, sf_dir))


# --- contracts ----------------------------------------------------------------------------------


def _sql_literal(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Per table: rule name -> SQL that is true for a broken row; written apart from the library.
_IS_UUID = "regexp_full_match({c}, '[0-9a-fA-F]{{8}}-?([0-9a-fA-F]{{4}}-?){{3}}[0-9a-fA-F]{{12}}')"


def _uuid_sql(c: str) -> str:
    return "NOT " + _IS_UUID.format(c=c)


_BROKEN = {
    "customers": {
        "customer_id:uuid": _uuid_sql("customer_id"),
        "acquisition_channel:enum": "acquisition_channel NOT IN ('organic_search', 'paid_search', 'social_media', 'email', 'referral', 'direct')",
        "age:range": "age < 18 OR age > 100",
        "gender:enum": "gender NOT IN ('M', 'F', 'Non-binary', 'Unknown')",
        "loyalty_tier:enum": "loyalty_tier NOT IN ('Bronze', 'Silver', 'Gold', 'Platinum')",
    },
    "transactions": {
        "transaction_id:uuid": _uuid_sql("transaction_id"),
        "customer_id:uuid": _uuid_sql("customer_id"),
        "order_value:range": "order_value < 0",
        "order_value:finite": "NOT isfinite(order_value)",
        "num_items:range": "num_items < 1",
        "payment_method:enum": "payment_method NOT IN ('credit_card', 'debit_card', 'paypal', 'crypto', 'buy_now_pay_later')",
        "discount_applied:range": "discount_applied < 0 OR discount_applied > 1",
    },
    "clickstream": {
        "session_id:uuid": _uuid_sql("session_id"),
        "customer_id:uuid": _uuid_sql("customer_id"),
        "page_type:enum": "page_type NOT IN ('home', 'category', 'product', 'cart', 'checkout', 'confirmation', 'search', 'account')",
        "time_on_page_seconds:range": "time_on_page_seconds < 0",
        "device_type:enum": "device_type NOT IN ('desktop', 'mobile', 'tablet')",
    },
    "support_tickets": {
        "ticket_id:uuid": _uuid_sql("ticket_id"),
        "customer_id:uuid": _uuid_sql("customer_id"),
        "sentiment_score:range": "sentiment_score < -1 OR sentiment_score > 1",
        "resolution_days:range": "resolution_days < 0",
    },
    "survival_labels": {
        "customer_id:uuid": _uuid_sql("customer_id"),
        "duration_days:range": "duration_days < 0",
        "total_orders:range": "total_orders < 0",
        "total_revenue:range": "total_revenue < 0",
    },
}
_REQUIRED = {
    "customers": "customer_id first_name last_name email country acquisition_channel registration_date gender loyalty_tier",
    "transactions": "transaction_id customer_id event_timestamp order_value num_items product_category payment_method is_returned discount_applied",
    "clickstream": "session_id customer_id event_timestamp page_type time_on_page_seconds device_type added_to_cart",
    "support_tickets": "ticket_id customer_id created_at topic raw_text sentiment_score resolved",
    "survival_labels": "customer_id first_purchase_date last_purchase_date duration_days event_observed total_orders total_revenue",
}
# Tables whose customer key is given the UUID form before the check.
_UUID_KEYED = {"customers", "survival_labels"}


def _contract_source(name: str):
    def source(spark, sf_dir) -> DataFrame:
        df = _SOURCES[name](spark, sf_dir)
        if name in _UUID_KEYED:
            df = df.withColumn("customer_id", retail.uuid_form(F.col("customer_id")))
        return df

    return source


def _contract_sql(name: str) -> str:
    key = "customer_id"
    if name in _UUID_KEYED:
        key = (
            "substr(md5(customer_id), 1, 8) || '-' || substr(md5(customer_id), 9, 4) || '-' || "
            "substr(md5(customer_id), 13, 4) || '-' || substr(md5(customer_id), 17, 4) || '-' || "
            "substr(md5(customer_id), 21, 12)"
        )
    rules = {f"{c}:required": f"{c} IS NULL" for c in _REQUIRED[name].split()} | _BROKEN[name]
    rows = f"rows_ AS (SELECT * REPLACE ({key} AS customer_id) FROM {_VIEW_OF[name]})"
    parts = [
        f"SELECT '{rule}' AS rule, count(*) FILTER (WHERE {broken}) AS n_rows FROM rows_"
        for rule, broken in rules.items()
    ]
    any_broken = " OR ".join(f"coalesce({b}, false)" for b in rules.values())
    parts.append(f"SELECT 'any', count(*) FILTER (WHERE {any_broken}) FROM rows_")
    head = sql("", _VIEW_OF[name]).rstrip()
    return head + ",\n" + rows + "\n" + "\nUNION ALL ".join(parts)


def _register_contract(name: str, contract: Contract) -> None:
    source = _contract_source(name)

    @register(f"contract_{name}", _contract_sql(name))
    def _contract(spark, sf_dir):
        return violation_counts(source(spark, sf_dir), contract)


for _name, _contract in CONTRACTS.items():
    _register_contract(_name, _contract)


@register(
    "contract_quarantine",
    sql(
        """SELECT customer_id, concat_ws(',',
                    CASE WHEN gender IS NULL THEN 'gender:required' END,
                    CASE WHEN acquisition_channel = 'billboard' THEN 'acquisition_channel:enum' END,
                    CASE WHEN age < 18 OR age > 100 THEN 'age:range' END,
                    CASE WHEN loyalty_tier = 'None' THEN 'loyalty_tier:enum' END) AS reasons
           FROM customers
           WHERE gender IS NULL OR acquisition_channel = 'billboard' OR age < 18 OR age > 100
                 OR loyalty_tier = 'None'""",
        "customers",
    ),
)
def _contract_quarantine(spark, sf_dir):
    rows = retail.customers(spark, sf_dir).withColumn("_id", F.col("customer_id"))
    keyed = rows.withColumn("customer_id", retail.uuid_form(F.col("customer_id")))
    _, quarantine = apply_contract(keyed, CONTRACTS["customers"])
    return quarantine.select(
        F.col("_id").alias("customer_id"), F.concat_ws(",", "violations").alias("reasons")
    )


# --- expectations -------------------------------------------------------------------------------


def _suite_sql(name: str) -> str:
    view = _VIEW_OF[name]
    parts = []
    for i, e in enumerate(SUITES[name]):
        c = e.column
        if e.kind == EXISTS:
            n, ok, source = "1", "1", "(SELECT 1)"
        elif e.kind == NOT_NULL:
            n, ok, source = "count(*)", f"count({c})", view
        elif e.kind == UNIQUE:
            n, ok = "coalesce(sum(k), 0)", "count(*) FILTER (WHERE k = 1)"
            source = f"(SELECT count(*) AS k FROM {view} WHERE {c} IS NOT NULL GROUP BY {c})"
        elif e.kind == IN_SET:
            n, ok, source = f"count({c})", f"count(*) FILTER (WHERE {c} IN {_sql_literal(e.values)})", view
        else:
            bounds = [f"{c} >= {e.low}"] if e.low is not None else []
            bounds += [f"{c} <= {e.high}"] if e.high is not None else []
            n, ok, source = f"count({c})", f"count(*) FILTER (WHERE {' AND '.join(bounds)})", view
        parts.append(
            f"SELECT '{name}' AS dataset, {i} AS position, '{e.kind}' AS expectation, "
            f"'{c}' AS \"column\", {e.mostly}::DOUBLE AS mostly, n::BIGINT AS n, ok::BIGINT AS ok, "
            f"coalesce(ok / nullif(n, 0) >= {e.mostly}, true) AS success "
            f"FROM (SELECT {n} AS n, {ok} AS ok FROM {source})"
        )
    return "\nUNION ALL ".join(parts)


def _register_suite(name: str) -> None:
    @register(f"suite_{name}", sql(_suite_sql(name), _VIEW_OF[name]))
    def _suite(spark, sf_dir):
        return run_suite(_SOURCES[name](spark, sf_dir), SUITES[name], name)


for _name in SUITES:
    _register_suite(_name)


@register(
    "validation_summary",
    sql(
        "SELECT dataset, count(*) AS n_expectations, count(*) FILTER (WHERE success) AS n_passed, "
        "count(*) FILTER (WHERE NOT success) AS n_failed, bool_and(success) AS success, "
        "round(count(*) FILTER (WHERE success) / count(*), 6) AS pass_rate, "
        "coalesce(string_agg(expectation || '(column=' || \"column\" || ')', ', ' "
        "ORDER BY expectation || '(column=' || \"column\" || ')') FILTER (WHERE NOT success), '') "
        "AS failures FROM (" + "\nUNION ALL ".join(_suite_sql(n) for n in SUITES) + ") GROUP BY dataset",
        *_VIEW_OF.values(),
    ),
)
def _validation_summary(spark, sf_dir):
    results = validate_all({n: f(spark, sf_dir) for n, f in _SOURCES.items()})
    return rounded(summarise(results), 6, "pass_rate").withColumn(
        "failures", F.concat_ws(", ", "failures")
    )


# --- integrity and faults -----------------------------------------------------------------------


@register(
    "orphan_rows",
    sql(
        "SELECT customer_id FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM clickstream)",
        "customers",
        "clickstream",
    ),
)
def _orphan_rows(spark, sf_dir):
    return orphans(
        retail.customers(spark, sf_dir).select("customer_id"), retail.clicks(spark, sf_dir), "customer_id"
    )


@register(
    "referential_integrity",
    sql(
        """SELECT count(*) AS n_orphans FROM purchases
           WHERE customer_id NOT IN (SELECT customer_id FROM customers)""",
        "purchases",
        "customers",
    ),
)
def _referential_integrity(spark, sf_dir):
    return orphans(
        retail.purchases(spark, sf_dir), retail.customers(spark, sf_dir), "customer_id"
    ).agg(F.count(F.lit(1)).alias("n_orphans"))


@register(
    "coverage",
    sql(
        """SELECT count(*) FILTER (WHERE customer_id IN (SELECT customer_id FROM clickstream)) AS n_covered,
                  count(*) AS n_total,
                  round(count(*) FILTER (WHERE customer_id IN (SELECT customer_id FROM clickstream))
                        / count(*), 6) AS coverage
           FROM (SELECT DISTINCT customer_id FROM customers)""",
        "customers",
        "clickstream",
    ),
)
def _coverage(spark, sf_dir):
    out = coverage(retail.clicks(spark, sf_dir), retail.customers(spark, sf_dir), "customer_id")
    return rounded(out, 6, "coverage")


@register(
    "label_coverage",
    sql(
        """SELECT *, n_labels = n_buyers AS complete
           FROM (SELECT (SELECT count(*) FROM labels) AS n_labels,
                        (SELECT count(DISTINCT customer_id) FROM purchases) AS n_buyers)""",
        "labels",
        "purchases",
    ),
)
def _label_coverage(spark, sf_dir):
    return label_coverage(labels(spark, sf_dir), retail.purchases(spark, sf_dir))


@register(
    "date_order",
    sql(
        "SELECT count(*) AS n_breaks FROM labels WHERE first_purchase_date > last_purchase_date",
        "labels",
    ),
)
def _date_order(spark, sf_dir):
    return out_of_order(
        labels(spark, sf_dir), "first_purchase_date", "last_purchase_date"
    ).agg(F.count(F.lit(1)).alias("n_breaks"))


@register(
    "value_shares",
    sql(
        """SELECT device_type AS "value", count(*) AS n,
                  round(count(*) / sum(count(*)) OVER (), 6) AS share
           FROM clickstream WHERE device_type IS NOT NULL GROUP BY device_type""",
        "clickstream",
    ),
)
def _value_shares(spark, sf_dir):
    return rounded(value_shares(retail.clicks(spark, sf_dir), "device_type"), 6, "share")


def _fault_sql(view: str, dataset: str, key: str, missing: list[str], numeric: list[str], ts: str | None, amount: str | None) -> str:
    gaps = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in missing) or "0"
    far = (
        " + ".join(
            f"(SELECT count(*) FROM {view} WHERE {c} > 10 * (SELECT quantile_cont({c}::DOUBLE, 0.99) FROM {view}))"
            for c in numeric
        )
        or "0"
    )
    future = f"count(*) FILTER (WHERE {ts} > end_at)" if ts else "0"
    negative = f"count(*) FILTER (WHERE {amount} < 0)" if amount else "0"
    end = "(SELECT TIMESTAMP '2000-12-31' AS end_at)"
    return f"""
        SELECT '{dataset}' AS dataset, 'missing' AS fault, ({gaps})::BIGINT AS n FROM {view}
        UNION ALL SELECT '{dataset}', 'outliers', ({far})::BIGINT
        UNION ALL SELECT '{dataset}', 'future_dates', ({future})::BIGINT FROM {view}, {end}
        UNION ALL SELECT '{dataset}', 'negative_amounts', ({negative})::BIGINT FROM {view}
        UNION ALL SELECT '{dataset}', 'duplicates', coalesce(sum(k - 1), 0)::BIGINT
                  FROM (SELECT count(*) AS k FROM {view} WHERE {key} IS NOT NULL GROUP BY {key})"""


_ORDER_LINES = """
    SELECT l_orderkey || '-' || l_linenumber AS line_id, l_quantity AS quantity,
           l_extendedprice - 5000 AS line_value, l_returnflag AS return_flag,
           l_shipdate AS ship_timestamp FROM lineitem"""


@register(
    "fault_report",
    "WITH order_lines AS ("
    + _ORDER_LINES
    + "), "
    + sql("", "transactions").removeprefix("WITH ")
    + _fault_sql(
        "transactions",
        "transactions",
        "transaction_id",
        ["order_value", "num_items", "product_category", "payment_method", "discount_applied"],
        ["order_value", "num_items", "discount_applied"],
        "event_timestamp",
        "order_value",
    )
    + "\nUNION ALL "
    + _fault_sql(
        "order_lines",
        "order_lines",
        "line_id",
        ["quantity", "line_value", "return_flag"],
        ["quantity", "line_value"],
        "ship_timestamp",
        "line_value",
    ),
)
def _fault_report(spark, sf_dir):
    end = datetime(2000, 12, 31)
    lines = retail.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") - 5000).alias("line_value"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_shipdate").alias("ship_timestamp"),
    )
    bought = materialise(retail.transactions(spark, sf_dir), "transactions")
    return fault_report(bought, "transactions", FaultAudit("transaction_id", end)).unionByName(
        fault_report(
            lines,
            "order_lines",
            FaultAudit("line_id", end, skip=FaultAudit("line_id").skip | {"line_id"}),
        )
    )


@register(
    "deduplicated_lines",
    """SELECT l_orderkey || '-' || l_linenumber AS line_id, l_partkey, l_quantity, l_shipdate
       FROM lineitem
       QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                  ORDER BY l_shipdate, l_partkey, l_quantity) = 1""",
)
def _deduplicated_lines(spark, sf_dir):
    lines = retail.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line_id"),
        "l_partkey",
        "l_quantity",
        "l_shipdate",
    )
    return drop_repeats(lines, "line_id", ["l_shipdate", "l_partkey", "l_quantity"])
