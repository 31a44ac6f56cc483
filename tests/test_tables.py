"""Labels, features, pipeline, contracts, suites, faults."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenure.operators.contracts import CONTRACTS, apply_contract, with_violations
from tenure.operators.features import (
    Behaviour,
    Demographics,
    Rfm,
    session_rollup,
    sessionise,
    ticket_features,
)
from tenure.operators.labels import (
    churned_identity_breaks,
    cohort_summary,
    signed_duration,
    survival_labels,
    window_end,
    with_targets,
)
from tenure.operators.pipeline import FeaturePipeline, Preprocessor, feature_columns
from tenure.operators.quality import (
    BETWEEN,
    SUITES,
    Expectation,
    FaultAudit,
    drop_repeats,
    fault_report,
    run_suite,
    summarise,
    validate_all,
)
from tenure.sources.io import read_table, write_bundle, write_table

from conftest import day


def by_customer(df):
    return {r["customer_id"]: r for r in df.collect()}


# --- labels -------------------------------------------------------------------------------------


def test_churn_rule_is_inclusive(spark):
    rows = [
        ("edge", day("2023-01-01"), day("2023-10-02")),  # exactly 90 days before the end
        ("late", day("2023-01-01"), day("2023-10-03")),
    ]
    tx = spark.createDataFrame(
        [(c, t, i) for c, a, b in rows for i, t in enumerate((a, b))],
        "customer_id string, event_timestamp timestamp, n int",
    ).withColumn("transaction_id", F.concat("customer_id", "n")).withColumn("order_value", F.lit(1.005))
    got = by_customer(survival_labels(tx, day("2023-12-31")))
    assert got["edge"]["event_observed"] is True
    assert got["edge"]["duration_days"] == 364.0
    assert got["late"]["event_observed"] is False
    assert got["late"]["duration_days"] == 364.0
    assert got["edge"]["total_orders"] == 2


def test_labels_of_zone_less_timestamps_ignore_clock_changes(spark):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        tx = spark.createDataFrame(
            [("c", "t", 1.0, "2023-03-25 00:00:00"), ("c", "u", 1.0, "2023-03-27 00:00:00")],
            "customer_id string, transaction_id string, order_value double, ts string",
        ).withColumn("event_timestamp", F.col("ts").cast("timestamp_ntz"))
        row = survival_labels(tx, day("2023-03-28"), threshold_days=30).first()
        assert row["duration_days"] == 3.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_churned_identity_and_summary(spark, shop):
    labels = survival_labels(shop["transactions"], day("2021-12-31"))
    assert churned_identity_breaks(labels).count() == 0
    row = cohort_summary(labels).first()
    assert row["churn_rate"] == 1.0
    assert row["median_revenue"] == 120.0


def test_signed_duration(spark):
    df = spark.createDataFrame([(False, 12.5), (True, 7.0), (False, 0.0)], "e boolean, d double")
    got = [r[0] for r in df.select(signed_duration(F.col("e"), F.col("d"))).collect()]
    assert got == [-12.5, 7.0, 0.0]


def test_target_of_unknown_customer_raises(spark, shop):
    rows = spark.createDataFrame([("nobody",)], "customer_id string")
    with pytest.raises(KeyError, match="nobody"):
        with_targets(rows, shop["labels"])


# --- features -----------------------------------------------------------------------------------


def test_purchase_features(shop):
    got = by_customer(Rfm(day("2021-08-01")).fit_transform(shop["transactions"]))
    assert {c: (r["frequency"], r["monetary_total"], r["recency_days"], r["n_categories"]) for c, r in got.items()} == {
        "ana": (3, 120.0, 32, 2), "ben": (1, 9.5, 105, 1), "cid": (2, 250.0, 13, 1)
    }
    assert got["ana"]["return_rate"] == pytest.approx(1 / 3) and got["cid"]["return_rate"] == 0.5
    assert (got["ana"]["monetary_mean"], got["ana"]["avg_items_per_order"]) == (40.0, 3.0)
    assert got["ana"]["avg_discount"] == pytest.approx(0.1)
    assert got["cid"]["monetary_std"] == pytest.approx(85 * 2**0.5)


def test_one_purchase_has_no_spread(shop):
    one = shop["transactions"].filter("customer_id = 'ben'")
    assert Rfm().fit_transform(one).first()["monetary_std"] == 0.0


def test_reference_date_is_learned_and_recency_rounds_down(shop):
    with pytest.raises(RuntimeError):
        Rfm().transform(shop["transactions"])
    fitted = Rfm().fit(shop["transactions"])
    assert fitted.fitted_date == window_end(shop["transactions"]) == day("2021-07-19")
    later = shop["transactions"].withColumn("event_timestamp", F.lit("2021-07-20 12:00:00").cast("timestamp"))
    assert fitted.transform(later).first()["recency_days"] == -2.0


def test_behaviour_features(shop):
    got = by_customer(Behaviour().fit(shop["clickstream"]).transform(shop["clickstream"]))
    assert sorted(got) == ["ana", "ben"]
    names = ["n_sessions", "avg_session_duration_s", "avg_pages_per_session", "cart_session_rate", "device_tablet_pct", "device_mobile_pct", "page_product_pct"]
    assert [got["ana"][n] for n in names] == [2, 52.5, 2.0, 0.5, 0.75, 0.0, 0.25]
    assert [got["ben"][n] for n in names] == [1, 100.0, 2.0, 1.0, 0.0, 1.0, 1.0]


def test_null_session_counts_in_shares_only(spark, shop):
    rows = [(None, c, day("2021-07-01"), "home", 500.0, "mobile", False) for c in ("ana", "zoe")]
    clicks = shop["clickstream"].unionByName(spark.createDataFrame(rows, shop["clickstream"].schema))
    got = by_customer(Behaviour().fit(clicks).transform(clicks))
    assert got["ana"]["n_sessions"] == 2
    assert got["ana"]["avg_session_duration_s"] == 52.5
    assert got["ana"]["device_mobile_pct"] == 0.2
    assert "zoe" not in got


def test_sessions_from_silences(spark):
    base = day("2024-01-01")
    offsets = [0, 10, 1799, 3599, 5399, 7199, 9000, 10_801, 20_000]
    rows = [("a", base + timedelta(seconds=s)) for s in offsets]
    clicks = spark.createDataFrame(rows, "customer_id string, event_timestamp timestamp")
    clicks = clicks.selectExpr(
        "*", "1.0D AS time_on_page_seconds", "true AS added_to_cart", "'x' AS device_type", "'y' AS page_type"
    )
    got = [r["session_id"] for r in sessionise(clicks, 1800).orderBy("event_timestamp").collect()]
    want, number = [], 0
    for i, s in enumerate(offsets):
        number += i == 0 or s - offsets[i - 1] > 1800
        want.append(f"a-{number}")
    assert got == want
    rolled = session_rollup(clicks, ["x"], gap_seconds=1800)
    counts = {r["session_id"]: r["pages_per_session"] for r in rolled.collect()}
    assert counts == {v: want.count(v) for v in want}


def test_ticket_features(shop):
    got = by_customer(ticket_features(shop["tickets"]))
    assert list(got) == ["ben"]
    assert (got["ben"]["n_tickets"], got["ben"]["avg_resolution_days"]) == (3, 2.5)
    assert got["ben"]["pct_resolved"] == pytest.approx(2 / 3)


def test_demographics_and_unseen_levels(spark, shop):
    fitted = Demographics().fit(shop["customers"])
    got = by_customer(fitted.transform(shop["customers"]))
    tiers = [got[c]["loyalty_tier_ordinal"] for c in ("cid", "ana", "ben")]
    assert tiers == sorted(set(tiers))
    other = spark.createDataFrame([("dot", 50.0, "X", "Iron", None)], shop["customers"].schema)
    row = fitted.transform(other).first()
    assert row["loyalty_tier_ordinal"] is None
    assert row["gender_F"] == row["gender_M"] == row["channel_email"] == 0.0


# --- feature matrix -----------------------------------------------------------------------------


def test_pipeline(shop):
    order = ("customers", "transactions", "clickstream", "tickets", "labels")
    tables = [shop[n] for n in order]
    with pytest.raises(RuntimeError):
        FeaturePipeline().transform(*tables)
    pipe = FeaturePipeline()
    out = pipe.fit_transform(*tables)
    rows = by_customer(out)
    assert [rows[c]["event"] for c in ("ana", "ben", "cid")] == [True, False, False]
    assert rows["cid"]["duration"] == 162.0
    pdf = out.toPandas()
    x = pdf[pipe.feature_names].to_numpy()
    assert not np.isnan(x).any()
    np.testing.assert_allclose(x.mean(axis=0), 0, atol=1e-9)
    assert set(np.round(x.std(axis=0), 9)) <= {0.0, 1.0}
    again = pipe.transform(*tables).toPandas().set_index("customer_id")
    np.testing.assert_allclose(
        again.loc[pdf.customer_id, pipe.feature_names].to_numpy(dtype=float), x
    )


def test_raw_matrix_counts_no_tickets_as_zero(shop):
    pipe = FeaturePipeline(scale=False).fit(
        *[shop[n] for n in ("customers", "transactions", "clickstream", "tickets", "labels")]
    )
    raw = by_customer(pipe.raw_features(*[shop[n] for n in ("customers", "transactions", "clickstream", "tickets", "labels")]))
    assert raw["cid"]["n_tickets"] == 0.0
    assert raw["cid"]["avg_sentiment"] is None


def test_preprocessor_moments(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 5.0), ("b", None, 5.0), ("c", 4.0, 5.0), ("d", 2.0, 5.0), ("e", 3.0, None)],
        "customer_id string, x double, k double",
    ).withColumn("empty", F.lit(None).cast("double"))
    fitted = Preprocessor.fit(df)
    assert fitted.medians["x"] == 2.5
    assert fitted.columns == ("x", "k")
    filled = np.array([1, 2.5, 4, 2, 3])
    got = fitted.transform(df).toPandas().sort_values("customer_id")["x"].to_numpy()
    np.testing.assert_allclose(got, (filled - filled.mean()) / filled.std())
    assert set(fitted.transform(df).toPandas()["k"]) == {0.0}
    with pytest.raises(TypeError):
        feature_columns(df.withColumn("s", F.lit("text")))


# --- contracts ----------------------------------------------------------------------------------

UUID = "3f2504e0-4f89-11d3-9a0c-0305e82c3301"
GOOD = {
    "customers": dict(
        customer_id=UUID, first_name="A", last_name="B", email="a@b.c", country="DE",
        acquisition_channel=" email ", registration_date=day("2023-01-01"), age=30, gender="F",
        loyalty_tier="Gold",
    ),
    "transactions": dict(
        transaction_id=UUID, customer_id=UUID, event_timestamp=day("2023-01-01"), order_value=5.0,
        num_items=1, product_category="Books", payment_method="paypal", is_returned=False,
        discount_applied=0.0,
    ),
    "clickstream": dict(
        session_id=UUID, customer_id=UUID, event_timestamp=day("2023-01-01"), page_type="home",
        time_on_page_seconds=1.0, device_type="mobile", added_to_cart=False, search_query=None,
    ),
    "support_tickets": dict(
        ticket_id=UUID, customer_id=UUID, created_at=day("2023-01-01"), topic="x", raw_text="y",
        sentiment_score=0.1, resolved=True, resolution_days=None,
    ),
    "survival_labels": dict(
        customer_id=UUID, first_purchase_date=day("2023-01-01"), last_purchase_date=day("2023-02-01"),
        duration_days=3.0, event_observed=True, total_orders=0, total_revenue=0.0,
    ),
}
BAD = [
    ("customers", {"age": 17}, "age:range"),
    ("customers", {"age": 101}, "age:range"),
    ("customers", {"acquisition_channel": "billboard"}, "acquisition_channel:enum"),
    ("customers", {"gender": "X"}, "gender:enum"),
    ("customers", {"gender": None}, "gender:required"),
    ("customers", {"customer_id": "c1"}, "customer_id:uuid"),
    ("transactions", {"order_value": -1.0}, "order_value:range"),
    ("transactions", {"order_value": float("inf")}, "order_value:finite"),
    ("transactions", {"discount_applied": 1.5}, "discount_applied:range"),
    ("transactions", {"num_items": 0}, "num_items:range"),
    ("clickstream", {"page_type": "landing"}, "page_type:enum"),
    ("support_tickets", {"sentiment_score": 1.5}, "sentiment_score:range"),
    ("survival_labels", {"duration_days": -1.0}, "duration_days:range"),
    ("survival_labels", {"total_revenue": -0.01}, "total_revenue:range"),
]


def contract_rows(spark, name, rows):
    schema = CONTRACTS[name].schema
    nullable = [type(f)(f.name, f.dataType, True) for f in schema.fields]
    return spark.createDataFrame(
        [tuple(r[f.name] for f in schema.fields) for r in rows], type(schema)(nullable)
    )


@pytest.mark.parametrize("name", list(GOOD))
def test_contract_names_what_is_broken(spark, name):
    cases = [(c, reason) for n, c, reason in BAD if n == name]
    rows = [GOOD[name]] + [GOOD[name] | c for c, _ in cases]
    got = [r["violations"] for r in with_violations(contract_rows(spark, name, rows).coalesce(1), CONTRACTS[name]).collect()]
    assert got == [[]] + [[reason] for _, reason in cases]


def test_contract_split_and_strip(spark):
    rows = [GOOD["customers"], GOOD["customers"] | {"age": None}, GOOD["customers"] | {"age": 5}]
    valid, bad = apply_contract(contract_rows(spark, "customers", rows), CONTRACTS["customers"])
    assert valid.count() == 2 and bad.count() == 1
    assert valid.first()["acquisition_channel"] == "email"


# --- suites and faults --------------------------------------------------------------------------


def clean(spark, name, n=100):
    rows = [GOOD[name] | ({"acquisition_channel": "email"} if name == "customers" else {}) for _ in range(n)]
    key = CONTRACTS[name].schema.fields[0].name
    df = contract_rows(spark, name, rows)
    if name == "survival_labels":
        df = df.withColumn("total_orders", F.lit(2).cast("bigint"))
    return df.withColumn(key, F.monotonically_increasing_id().cast("string"))


def failures(df, name):
    row = summarise(run_suite(df, SUITES[name], name)).first()
    return row["failures"]


@pytest.mark.parametrize("name", list(SUITES))
def test_clean_tables_pass(spark, name):
    assert failures(clean(spark, name), name) == []


def test_planted_faults_fail(spark):
    customers = clean(spark, "customers")
    assert failures(customers.withColumn("gender", F.lit("X")), "customers") == [
        "expect_column_values_to_be_in_set(column=gender)"
    ]
    same = customers.withColumn("customer_id", F.lit("one"))
    assert failures(same, "customers") == ["expect_column_values_to_be_unique(column=customer_id)"]
    tx = clean(spark, "transactions")
    few = F.when(F.col("transaction_id").cast("long") % 25 == 0, -50.0).otherwise(F.col("order_value"))
    many = F.when(F.col("transaction_id").cast("long") % 5 == 0, -50.0).otherwise(F.col("order_value"))
    assert failures(tx.withColumn("order_value", few), "transactions") == []
    assert len(failures(tx.withColumn("order_value", many), "transactions")) == 1
    assert "expect_column_to_exist(column=session_id)" in failures(
        clean(spark, "clickstream").drop("session_id"), "clickstream"
    )
    nulls = clean(spark, "support_tickets").withColumn("sentiment_score", F.lit(None).cast("double"))
    assert failures(nulls, "support_tickets") == []


def test_absent_tables_are_skipped(spark):
    got = validate_all({"customers": clean(spark, "customers")})
    assert {r["dataset"] for r in got.collect()} == {"customers"}


def test_fault_report(spark):
    rows = [(str(i), "a", day("2023-01-01"), 10.0) for i in range(1000)]
    rows += [("0", "a", day("2023-01-01"), 10.0)] * 3
    rows += [("x", None, day("2028-01-01"), -10.0), ("y", "a", day("2023-01-01"), 5000.0)]
    df = spark.createDataFrame(rows, "transaction_id string, kind string, event_timestamp timestamp, order_value double")
    got = {r["fault"]: r["n"] for r in fault_report(df, "t", FaultAudit("transaction_id", day("2023-12-31"))).collect()}
    assert got == {"missing": 1, "outliers": 1, "future_dates": 1, "negative_amounts": 1, "duplicates": 3}
    assert drop_repeats(df, "transaction_id").count() == 1002
    lost = spark.createDataFrame([(None, 1), (None, 1), ("a", 1), ("a", 2), ("b", 1)], "k string, v int")
    assert drop_repeats(lost, "k").count() == 4


def test_sessionise_keeps_events_without_customer_or_time(spark):
    rows = [("a", day("2023-01-01")), (None, day("2023-01-01")), ("a", None)]
    got = sessionise(spark.createDataFrame(rows, "customer_id string, event_timestamp timestamp"), 1800).collect()
    assert len(got) == 3 and sum(r["session_id"] is None for r in got) == 2


# --- files --------------------------------------------------------------------------------------


def test_tables_round_trip(spark, shop, tmp_path):
    path = str(tmp_path / "deep" / "labels")
    write_table(shop["labels"], path)
    assert read_table(spark, path).exceptAll(shop["labels"]).count() == 0
    with pytest.raises(Exception, match="exists"):
        write_table(shop["labels"], path, overwrite=False)
    with pytest.raises(Exception, match="(?i)path does not exist|PATH_NOT_FOUND"):
        read_table(spark, str(tmp_path / "none"))
    paths = write_bundle({"customers": shop["customers"]}, str(tmp_path / "bundle"))
    assert read_table(spark, paths["customers"]).count() == 3


# --- untyped input ------------------------------------------------------------------------------


def test_untyped_rows_are_converted_or_named(spark):
    key = "00000000-0000-4000-8000-00000000000"
    rows = [
        (f"{key}1", f"{key}a", "2024-01-05 10:00:00", "12.5", 2.0, "toys", "paypal", "true", 0),
        (f"{key}2", f"{key}a", "yesterday", "12.5", 2.5, "toys", "paypal", "maybe", 0),
        (f"{key}3", f"{key}a", "2024-01-05", "n/a", None, "toys", "paypal", "no", 3),
    ]
    df = spark.createDataFrame(
        rows,
        "transaction_id string, customer_id string, event_timestamp string, order_value string, num_items double, "
        "product_category string, payment_method string, is_returned string, discount_applied int",
    )
    contract = CONTRACTS["transactions"]
    named = [set(r["violations"]) for r in with_violations(df, contract).orderBy("transaction_id").collect()]
    assert named == [
        set(),
        {"event_timestamp:type", "num_items:type", "is_returned:type"},
        {"order_value:type", "num_items:required", "discount_applied:range"},
    ]
    valid, bad = apply_contract(df, contract)
    assert dict(valid.dtypes)["num_items"] == "int" and valid.first()["event_timestamp"] == datetime(2024, 1, 5, 10)
    assert valid.first()["is_returned"] is True and bad.filter("num_items = 2.5").count() == 1
    fewer = df.drop("payment_method").withColumn("product_category", F.lit(7))
    got = with_violations(fewer, contract).orderBy("transaction_id").first()["violations"]
    assert got == ["payment_method:column", "product_category:type"]


def test_nan_is_missing_and_names_may_hold_dots(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", nan, None), ("c", 5.0, nan), ("d", 3.0, 8.0)], "customer_id string, `x.y` double, z double")
    fitted = Preprocessor.fit(df)
    assert fitted.medians == {"x.y": 3.0, "z": 5.0}
    out = {r["customer_id"]: r for r in fitted.transform(df).collect()}
    assert out["b"]["x.y"] == 0 and out["b"]["z"] == out["c"]["z"] == 0
    judged, passed = Expectation(BETWEEN, "z", low=1.0).counts()
    assert tuple(df.agg(judged, passed).first()) == (2, 2)


def test_fence_of_a_column_that_is_mostly_zero(spark):
    df = spark.createDataFrame([(i, 0.0 if i < 995 else 4.0, -1.0 * i) for i in range(1000)], "k int, zeros double, below double")
    report = {r["fault"]: r["n"] for r in fault_report(df, "t", FaultAudit(key="k", outlier_cols=("zeros", "below"))).collect()}
    assert report["outliers"] == 0
