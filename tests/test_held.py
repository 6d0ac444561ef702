"""Rows that are held: the same rows, compact, and never broadcast on a guess of their size."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltstone.operators import graph
from siltstone.session import held


def static_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_held_keeps_rows_and_hides_the_size(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"))
    kept = held(df)
    assert sorted(kept.collect()) == sorted(df.collect()) and kept.dtypes == df.dtypes
    assert "BroadcastHashJoin" in static_plan(df.join(df.withColumnRenamed("s", "t"), "id"))
    assert "BroadcastHashJoin" not in static_plan(kept.join(kept.withColumnRenamed("s", "t"), "id"))
    assert held(df.where("id < 0")).count() == 0


def test_s21_calls_broadcasts_nothing_on_a_guess(spark):
    assert "BroadcastHashJoin" not in static_plan(entry.queries()["s21_calls"](spark, "/root/testdata/sf0.001"))


def test_g12_broadcasts_nothing_on_a_guess(spark, monkeypatch):
    """Neither the answer nor any table that is made on the way to it."""
    made, frame = [], type(spark.range(1))
    checkpoint = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, *a, **k: made.append(static_plan(df)) or checkpoint(df, *a, **k))
    answer = static_plan(entry.queries()["g12_trace_routes"](spark, "/root/testdata/sf0.001"))
    assert "Join" in answer and sum("Join" in x for x in made) >= 5
    assert not [x for x in [*made, answer] if "Broadcast" in x]


def test_only_missing_methods_climb(spark):
    calls = spark.createDataFrame([("a", "C", "own"), ("a", "C", "up"), ("b", "C", "up"), ("b", "C", "nobody"), ("b", "L1", "x"), ("b", "X", "y")], "src string, cls string, method string")
    methods = spark.createDataFrame([("C", "own"), ("A", "up"), ("A", "own")], "cls string, method string")
    parents = spark.createDataFrame([("C", "B"), ("B", "A"), ("L1", "L2"), ("L2", "L1")], "cls string, parent string")
    rows = {tuple(r) for r in graph.resolve_inherited(calls, methods, parents).collect()}
    assert rows == {("a", "C", "own", "C"), ("a", "C", "up", "A"), ("b", "C", "up", "A"), ("b", "C", "nobody", "C"), ("b", "L1", "x", "L1"), ("b", "X", "y", "X")}
