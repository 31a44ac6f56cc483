from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenure.functions.special import chi_square_tail
from tenure.operators.drift import (
    ReferenceProfile,
    alert_digest,
    binned_scores,
    chi_square_scores,
    dataset_drift,
    drift_alerts,
    drift_gate,
    drift_report,
    drift_rule,
    epps_singleton,
    ordered_scores,
)

COLUMNS = ["num_a", "num_b", "num_c"]


def pair(spark, seed, shift):
    rng = np.random.default_rng(seed)

    def side(mean):
        return spark.createDataFrame(pd.DataFrame({c: rng.normal(mean, 1, 300) for c in COLUMNS}))

    return side(0.0), side(shift)


@pytest.fixture(scope="module")
def stable(spark):
    return pair(spark, 0, 0.0)


@pytest.fixture(scope="module")
def drifted(spark):
    return pair(spark, 1, 10.0)


def test_chi_square_tail():
    # Closed forms: two degrees exp(-x/2); four degrees exp(-x/2)(1 + x/2).
    for x in (0.5, 3.0, 12.0, 80.0):
        assert chi_square_tail(x, 2) == pytest.approx(np.exp(-x / 2), rel=1e-10)
        assert chi_square_tail(x, 4) == pytest.approx(np.exp(-x / 2) * (1 + x / 2), rel=1e-10)
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, rel=1e-9)
    assert chi_square_tail(float("inf"), 3) == 0.0


@pytest.mark.parametrize("limit", [50_000, 60])
def test_ordered_scores_match_brute_force(spark, limit):
    rng = np.random.default_rng(5)
    a = np.round(rng.normal(size=400), 2)
    b = np.round(rng.normal(0.3, 1.2, size=300), 2)
    b[:100] = 0.25  # one value holds a third of a side
    got = ordered_scores(
        spark.createDataFrame(pd.DataFrame({"x": a, "y": a})),
        spark.createDataFrame(pd.DataFrame({"x": b, "y": b + 1})),
        ["x", "y"],
        limit=limit,
    )
    got = {r["column"]: r for r in got.collect()}
    for name, other in (("x", b), ("y", b + 1)):
        at = np.unique(np.concatenate([a, other]))
        f = np.searchsorted(np.sort(a), at, side="right") / len(a)
        g = np.searchsorted(np.sort(other), at, side="right") / len(other)
        width = np.diff(at)
        gap = np.abs(f - g)
        r = got[name]
        assert r["ks_distance"] == pytest.approx(gap.max())
        assert r["wasserstein"] == pytest.approx((gap[:-1] * width).sum() / a.std())
        assert r["energy"] == pytest.approx(np.sqrt(2 * (gap[:-1] ** 2 * width).sum()))


def test_default_report(stable, drifted):
    calm = drift_report(*stable)
    assert {r["column"] for r in calm.collect()} == set(COLUMNS)
    assert not drift_gate(calm)
    assert drift_alerts(calm).count() == 0
    assert alert_digest(drift_alerts(calm)).first()["digest"] == "No drift alerts."
    loud = drift_report(*drifted)
    row = dataset_drift(loud).first()
    assert row["n_drifted"] == 3 and row["dataset_drift"]
    assert row["summary"] == "[DRIFTED] 3/3 features drifted (100.0%)"
    assert drift_gate(loud)


@pytest.mark.parametrize("method", ["psi", "kl_div", "jensenshannon", "hellinger", "wasserstein", "ed", "es"])
def test_every_numeric_method_finds_the_shift(drifted, method):
    assert drift_report(*drifted, num_method=method).filter("drifted").count() == 3


def test_epps_singleton_on_equal_sides(stable):
    for r in epps_singleton(*stable, COLUMNS).collect():
        assert r["es_p"] > 0.001


def test_unknown_method_and_column(stable):
    with pytest.raises(ValueError):
        drift_report(*stable, num_method="chi2")
    with pytest.raises(KeyError):
        drift_report(*stable, columns=["nope"])


def test_categories(spark):
    ref = spark.createDataFrame([("a",)] * 60 + [("b",)] * 40, "v string")
    cur = spark.createDataFrame([("a",)] * 30 + [("b",)] * 20, "v string")
    new = spark.createDataFrame([("a",)] * 30 + [("z",)] * 20, "v string")
    same = chi_square_scores(ref, cur, ["v"]).first()
    assert same["statistic"] == 0 and same["chi2_p"] == 1.0
    assert chi_square_scores(ref, new, ["v"]).first()["chi2_p"] == 0.0
    shares = {"a": (0.6, 0.6), "b": (0.4, 1e-4), "z": (1e-4, 0.4)}
    want = sum((c - r) * np.log(c / r) for r, c in shares.values())
    assert binned_scores(ref, new, categorical=["v"]).first()["psi"] == pytest.approx(want)


def test_few_valued_numbers_are_compared_by_value(spark):
    ref = spark.createDataFrame([(float(i % 4),) for i in range(100)], "x double")
    cur = spark.createDataFrame([(float(i % 2),) for i in range(100)], "x double")
    want = 2 * (0.5 - 0.25) * np.log(2) + 2 * (1e-4 - 0.25) * np.log(1e-4 / 0.25)
    assert binned_scores(ref, cur, numeric=["x"]).first()["psi"] == pytest.approx(want)


def test_histogram_divergence(spark, stable):
    ref, cur = (df.toPandas()["num_a"].to_numpy() for df in stable)
    both = np.concatenate([ref, cur])
    edges = np.linspace(both.min(), both.max(), int(np.ceil(np.log2(len(both)))) + 2)
    r = np.histogram(ref, edges)[0] / len(ref)
    c = np.histogram(cur, edges)[0] / len(cur)
    used = (r + c) > 0
    r, c = np.where(r == 0, 1e-4, r)[used], np.where(c == 0, 1e-4, c)[used]
    got = {x["column"]: x for x in binned_scores(*stable, numeric=["num_a"]).collect()}["num_a"]
    m = (r + c) / 2
    assert got["psi"] == pytest.approx(((c - r) * np.log(c / r)).sum())
    assert got["kl_div"] == pytest.approx((r * np.log(r / c)).sum())
    assert got["jensenshannon"] == pytest.approx(np.sqrt(0.5 * (r * np.log(r / m) + c * np.log(c / m)).sum()))
    assert got["hellinger"] == pytest.approx(np.sqrt(0.5 * ((np.sqrt(r) - np.sqrt(c)) ** 2).sum()))


def test_rule_severity_and_order(spark):
    cases = [
        ("psi", 0.25, 0.1, True),
        ("PSI", 0.05, 0.1, False),
        ("ks", 0.01, 0.05, True),
        ("ks", 0.5, 0.05, False),
        ("wasserstein", 1.5, 0.1, True),
        ("chi2", 0.001, 0.05, True),
    ]
    df = spark.createDataFrame(cases, "method string, score double, threshold double, want boolean")
    for r in df.withColumn("got", drift_rule(F.col("method"), F.col("score"), F.col("threshold"))).collect():
        assert r["got"] == r["want"], r
    report = spark.createDataFrame(
        [
            ("b", "psi", 0.15, 0.1, True),
            ("z", "psi", 0.25, 0.1, True),
            ("a", "ks", 0.01, 0.05, True),
            ("q", "ks", 0.9, 0.05, False),
        ],
        "column string, method string, score double, threshold double, drifted boolean",
    )
    alerts = drift_alerts(report)
    assert [(r["feature"], r["severity"]) for r in alerts.collect()] == [
        ("a", "critical"),
        ("z", "critical"),
        ("b", "warning"),
    ]
    assert alert_digest(alerts).first()["digest"].splitlines() == [
        "Drift alerts: 3 total (2 critical, 1 warning)",
        "  [CRITICAL] a: ks=0.0100 (threshold=0.05)",
        "  [CRITICAL] z: psi=0.2500 (threshold=0.1)",
        "  [WARNING] b: psi=0.1500 (threshold=0.1)",
    ]
    assert dataset_drift(report, 0.75).first()["dataset_drift"]


@pytest.mark.parametrize("method", ["ks", "wasserstein", "ed", "psi", "es"])
def test_a_column_without_values_does_not_end_the_report(spark, method):
    reference = spark.createDataFrame([(float(i), None, "a", None) for i in range(60)], "x double, y double, k string, m string")
    current = spark.createDataFrame([(float(i % 7), float(i), "b", "c") for i in range(60)], "x double, y double, k string, m string")
    cat = "psi" if method == "psi" else "chi2"
    rows = {r["column"]: r for r in drift_report(reference, current, num_method=method, cat_method=cat).collect()}
    assert set(rows) == {"x", "y", "k", "m"}
    assert rows["x"]["drifted"] and rows["k"]["drifted"]
    for c in ("y", "m"):
        assert rows[c]["score"] is None and not rows[c]["drifted"]
    only = drift_report(reference, current, columns=["y"], num_method=method).collect()
    assert [(r["column"], r["score"]) for r in only] == [("y", None)]


@pytest.mark.parametrize("limit", [50_000, 30])
def test_a_profile_stands_for_its_table(spark, tmp_path, limit):
    """All methods give what the reference table gives, for fine and coarse numbers, gaps and names with dots."""
    rng = np.random.default_rng(7)

    def side(n, shift):
        pdf = pd.DataFrame({"fine": rng.normal(shift, 1, n), "coarse": rng.integers(0, 6, n).astype(float), "a.b": np.round(rng.normal(0, 2, n), 1)})
        pdf.loc[::9, "fine"] = np.nan
        pdf["kind"] = rng.choice(["x", "y", "z"], n)
        return spark.createDataFrame(pdf).repartition(3)

    reference, current = side(400, 0.0), side(300, 0.3)
    profile = ReferenceProfile.fit(reference, str(tmp_path / "profile"))
    assert profile.numeric == ["fine", "coarse", "a.b"] and profile.categorical == ["kind"]
    again = ReferenceProfile(spark, str(tmp_path / "profile"))
    number = ["fine", "coarse", "a.b"]

    def figures(table):
        return sorted(tuple(r) for r in table.collect())

    for run in (
        lambda r: ordered_scores(r, current, number, limit),
        lambda r: epps_singleton(r, current, number, limit),
        lambda r: binned_scores(r, current, number, ["kind"]),
        lambda r: chi_square_scores(r, current, ["kind"]),
        lambda r: drift_report(r, current).select("column", "method", "score"),
    ):
        for got, want in zip(figures(run(again)), figures(run(reference)), strict=True):
            assert got == pytest.approx(want, abs=1e-9) if not isinstance(got[1], str) else got[:2] == want[:2] and got[2] == pytest.approx(want[2])
