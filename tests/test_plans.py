from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenure.plans.materialise import CHECKPOINT_CONF, checkpoint_root, materialise
from tenure.plans.ordered import (
    BUCKET,
    average_ranks,
    dense_ranks,
    measure_splits,
    running,
    step_lookup,
    with_bucket,
)
from tenure.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=3000), 2)
    v[:1000] = 0.5  # one value holds a third of the rows
    return v


@pytest.mark.parametrize("limit", [50_000, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_match_pandas(spark, values, limit, descending):
    df = spark.createDataFrame(pd.DataFrame({"k": values}))
    splits = measure_splits(df, ["k"], limit)["k"]
    assert splits.bucketed == (limit == 40)
    cells = with_bucket(df, splits).groupBy(BUCKET, "k").agg(F.count("*").alias("n"))
    got = running(cells, "k", {"n": F.col("n")}, descending=descending, bucketed=splits.bucketed)
    got = got.toPandas().set_index("k")["n"].sort_index()
    want = pd.Series(values).value_counts().sort_index(ascending=not descending).cumsum()
    pd.testing.assert_series_equal(got, want.sort_index(), check_names=False, check_dtype=False)


@pytest.mark.parametrize("limit", [50_000, 40])
def test_running_product(spark, limit):
    pdf = pd.DataFrame({"k": np.arange(200.0), "f": np.linspace(0.99, 1.0, 200)})
    df = spark.createDataFrame(pdf)
    splits = measure_splits(df, ["k"], limit)["k"]
    got = running(
        with_bucket(df, splits), "k", {"f": F.col("f")}, product=True, bucketed=splits.bucketed
    ).toPandas().sort_values("k")
    np.testing.assert_allclose(got["f"], pdf.f.cumprod(), rtol=1e-12)


@pytest.mark.parametrize("limit", [50_000, 40])
def test_ranks(spark, values, limit):
    df = spark.createDataFrame(pd.DataFrame({"k": values}))
    splits = measure_splits(df, ["k"], limit)["k"]
    dense = dense_ranks(df, "k", "r", splits).toPandas().set_index("k")["r"].sort_index()
    assert list(dense) == list(range(len(dense)))
    mean = average_ranks(df, "k", "r", splits).toPandas().set_index("k")["r"]
    want = pd.Series(pd.Series(values).rank().to_numpy(), index=values)
    for k in list(mean.index)[:50]:
        assert mean[k] == want.loc[[k]].iloc[0]


@pytest.mark.parametrize("limit", [1000, 10])
def test_step_lookup(spark, values, limit):
    steps = pd.DataFrame({"t": np.arange(-2.0, 2.0, 0.1), "v": np.arange(40)})
    rows = spark.createDataFrame(pd.DataFrame({"i": range(len(values)), "x": values}))
    got = step_lookup(rows, "x", spark.createDataFrame(steps), "t", ["v"], limit=limit)
    got = got.toPandas().sort_values("i")
    at = np.searchsorted(steps.t.to_numpy(), values, side="right") - 1
    want = np.where(at >= 0, at, np.nan)
    np.testing.assert_array_equal(got["v"].to_numpy(dtype=float), want)
    assert len(got) == len(values)


@pytest.mark.parametrize("limit", [200_000, 300, 20])
def test_exact_quantiles(spark, values, limit):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": values, "b": rng.normal(size=len(values)), "c": rng.random(len(values))})
    pdf.loc[::7, "c"] = np.nan
    df = spark.createDataFrame(pdf).select(
        "a", "b", F.when(~F.isnan("c"), F.col("c")).alias("c"), F.lit(None).cast("double").alias("d")
    )
    got = exact_quantiles(df, ["a", "b", "c", "d"], [0.25, 0.5, 0.99], limit=limit)
    for c in "abc":
        np.testing.assert_allclose(got[c], pdf[c].dropna().quantile([0.25, 0.5, 0.99]), atol=1e-12)
    assert got["d"] == [None, None, None]


def test_quantiles_of_any_doubles(spark):
    """Signs, zeros of both signs, the smallest and greatest numbers, infinities and one value that fills most rows."""
    rng = np.random.default_rng(4)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, float("inf"), float("-inf"), 1.0, np.nextafter(1.0, 2.0)] * 7
    v = np.concatenate([odd, rng.normal(size=500) * 10.0 ** rng.integers(-300, 300, 500), np.full(2000, -3.25)])
    df = spark.createDataFrame(pd.DataFrame({"a.b": v})).repartition(5)
    got = exact_quantiles(df, ["a.b"], [i / (len(v) - 1) for i in range(0, len(v), 97)], limit=10)["a.b"]
    assert got == np.sort(v)[::97].tolist()


def test_both_zeros_are_one_key(spark):
    df = spark.createDataFrame(pd.DataFrame({"k": [0.0, -0.0, -1.0, 1.0, 2.0, -2.0] * 20}))
    splits = measure_splits(df, ["k"], limit=1)["k"]
    cells = with_bucket(df, splits).groupBy(BUCKET, "k").count().collect()
    assert 0.0 in splits.points and sorted((r["k"], r["count"]) for r in cells) == [(-2.0, 20), (-1.0, 20), (0.0, 40), (1.0, 20), (2.0, 20)]


def test_borders_come_from_distinct_keys(spark):
    """A value most rows share leaves the borders to the others."""
    df = spark.createDataFrame(pd.DataFrame({"k": np.concatenate([np.zeros(20_000), np.arange(400.0)])}))
    points = measure_splits(df, ["k"], limit=20)["k"].points
    assert len(points) >= 15


def test_merged_lookup_of_rows_that_repeat(spark):
    steps = spark.createDataFrame(pd.DataFrame({"t": np.arange(50.0), "v": np.arange(50)}))
    rows = spark.createDataFrame(pd.DataFrame({"x": np.concatenate([np.full(3000, 7.5), np.arange(100.0) - 3])}))
    got = step_lookup(rows, "x", steps, "t", ["v"], limit=5).groupBy("x", "v").count().collect()
    assert {(r["x"], r["v"]): r["count"] for r in got} == {
        (7.5, 7): 3000, **{(float(x), None if x < 0 else min(x, 49)): 1 for x in range(-3, 97)}
    }


class NamedFolder:
    """A session whose settings name a checkpoint folder."""

    def __init__(self, spark, folder):
        self._spark, self._folder = spark, folder
        self.conf = self

    def get(self, key, default=None):
        return self._folder if key == CHECKPOINT_CONF else self._spark.conf.get(key, default)

    def __getattr__(self, name):
        return getattr(self._spark, name)


def test_checkpoint_folder(spark, tmp_path):
    assert checkpoint_root(NamedFolder(spark, f"{tmp_path}/")) == str(tmp_path)
    root = checkpoint_root(spark)
    assert root == checkpoint_root(spark)
    df = materialise(spark.range(5), "five")
    assert df.count() == 5
    assert any(f.startswith("five-") for f in os.listdir(root.removeprefix("file:")))
