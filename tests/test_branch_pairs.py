"""Pairs of branches: brute force over several blocks, and no pair is ever shuffled."""

import random
from itertools import combinations

import pytest

import __spark_entry__ as entry
from siltstone.operators import changes


@pytest.mark.parametrize("block", [3, 1024])
def test_sharing_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(changes, "BLOCK", block)
    monkeypatch.setattr(changes, "ROWS", 2)
    rng = random.Random(4)
    rows = {(f"b{rng.randrange(11)}", rng.choice("xxyyzuvw")): rng.choice([None, "1", "2"]) for _ in range(60)}
    rows |= {("lonely", "q"): "1"}
    gone = [("b1", "b2"), ("b4", "b3"), ("b5", "nobody"), ("b6", "b10")]
    df = spark.createDataFrame([(b, c, o) for (b, c), o in rows.items()] + [(None, "x", None), ("b1", None, None)], "branch string, community string, alone string")
    got = {tuple(r) for r in changes.sharing_pairs(df, spark.createDataFrame(gone, "a string, b string")).collect()}
    want = set()
    for a, b in combinations(sorted({b for b, _ in rows}), 2):
        n = sum((b, c) in rows and (o is None or o != rows[b, c]) for (x, c), o in rows.items() if x == a)
        if n and (a, b) not in gone and (b, a) not in gone:
            want.add((a, b, n))
    assert got == want
    assert changes.sharing_pairs(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["j20_branch_pairs", "j20_unrelated_pairs"])
def test_pairs_are_not_aggregated_after_they_met(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.find("LogicalRDD")]
    assert "Aggregate [a" not in above and "FlatMapGroupsInArrow" in above
