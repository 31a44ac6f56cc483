"""The driver contract, and a sample of registered queries against their SQL."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402
from check import connect, table  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "survival_labels",
    "cohort_summary",
    "contract_customers",
    "suite_survival_labels",
    "fault_report",
    "rfm_features",
    "behaviour_features",
    "feature_matrix_scaled",
    "survival_curve",
    "survival_all_times",
    "cox_derivatives",
    "boosted_first_tree",
    "contract_types",
    "drift_report_default",
    "cox_fit_small",
    "c_index",
    "td_auc",
    "folds",
    "batch_score",
    "drift_wasserstein",
    "drift_report",
    "alert_digest",
    "stream_sessions",
]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "duration_days" in df.columns


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(entry.oracle_sql()[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())
