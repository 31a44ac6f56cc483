"""The queries of this subpackage that have SQL against it, on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(ROOT, "tools"))

from check import connect, table  # noqa: E402
from tenure.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = connect(SF).execute(queries.ORACLES[name])
    assert got == table([d[0] for d in cur.description], cur.fetchall())
