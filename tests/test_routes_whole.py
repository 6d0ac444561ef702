"""Route queries at size: facts of one kind are unpacked alone, the history is read once and moved once."""

import re

import pytest

import __spark_entry__ as entry
from siltstone.operators import codegraph
from siltstone.session import held

SMALL = "/root/testdata/sf0.001"
FACTS = r"Scan ExistingRDD\[path#\d+,kind#\d+,a#\d+"


def static_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_held_by_a_column_unpacks_one_value(spark):
    df = spark.createDataFrame([("x", i % 7, "edge" if i % 3 else "symbol") for i in range(500)], "a string, n int, kind string")
    kept = held(df, "kind", ("symbol", "edge", "route"))
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.dtypes == df.dtypes
    one = kept.where("kind = 'edge'")
    assert sorted(one.collect()) == sorted(df.where("kind = 'edge'").collect())
    assert one._jdf.queryExecution().sparkPlan().toString().count("ExistingRDD") == 1
    assert kept.where("kind = 'route'").count() == 0
    with pytest.raises(Exception, match="unknown values of kind"):
        held(df, "kind", ("symbol",))


def test_g13_reads_and_moves_the_history_once(spark):
    plan = entry.queries()["g13_impact_routes"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    scans = re.findall(r"FileScan parquet \[([lo])_orderkey", plan)
    assert sorted(scans) == ["l", "o"]
    assert not re.search(FACTS, plan)
    lines = [x.strip(" :+-|") for x in plan.split("\n")]
    window = next(i for i, x in enumerate(lines) if x.startswith("Window"))
    assert "Exchange" not in "".join(x.split()[0] for x in lines[window : next(i for i in range(window, len(lines)) if "Join" in lines[i])])


def test_g12_unpacks_symbols_only_and_routes_once(spark):
    assert len(re.findall(r"Scan ExistingRDD\[path#\d+,a#\d+|" + FACTS, static_plan(entry.queries()["g12_trace_routes"](spark, SMALL)))) == 1


def test_impact_counts_all(spark):
    """Scripts count like routes without the history; a method in two files counts twice, a file without history weighs 1."""
    facts = spark.createDataFrame(
        [("f", "symbol", "A::m", "method", "public", None, 1, 9), ("g", "symbol", "A::m", "method", "public", None, 1, 9), ("h", "symbol", "C::go", "method", "public", None, 1, 9)]
        + [("h", "edge", "C::go", "A::m", "call", None, 2, 2)] * 2,
        "path string, kind string, a string, b string, c string, d string, first_line int, last_line int",
    )
    routes = spark.createDataFrame([("/x", ["GET"], "C::go", "h", None)], "path string, methods array<string>, action string, file string, template string")
    hunks = spark.createDataFrame([("f", 3, 3), ("g", 3, 3)], "file string, start int, end int")
    hot = spark.createDataFrame([("f", 2.5), ("other", 9.0)], "file string, score double")
    fetches = spark.createDataFrame([("js:s", "C::go"), ("js:t", None)], "src string, action string")
    rows = {tuple(r) for r in codegraph.impact(hunks, facts, routes, hot, fetches).collect()}
    assert rows == {("route", "/x", 2, 1, 3.5), ("script", "js:s", 2, 2, None)}
