"""The queries run, and agree with their SQL where there is one."""

import pytest
from compare import difference
from siltstone.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_agrees_with_sql(spark, small, name):
    assert difference(Q.QUERIES[name](spark, small), Q.ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_runs(spark, small, name):
    if name.startswith("p7"):
        pytest.importorskip("tiktoken")
    df = Q.QUERIES[name](spark, small)
    assert df.columns and df.count() > 0
