"""Every core query agrees with its SQL where there is one."""

import pytest
from compare import difference
from siltstone.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


def test_oracles_belong_to_queries():
    assert not set(ORACLES) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, small, name):
    assert difference(QUERIES[name](spark, small), ORACLES[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_the_same_rows_again(spark, small, name):
    """Queries without SQL are compared in test_twins and test_pages; here: rows, a schema, and no dependence on partitions."""
    first = QUERIES[name](spark, small)
    rows = sorted(map(str, first.collect()))
    assert first.columns and (rows or name == "g07_cycles_pages")  # the small documents have no cycle
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = QUERIES[name](spark, small)
        assert again.schema == first.schema and sorted(map(str, again.collect())) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
