"""Fuzzy matches: the same as comparing every pair, with few comparisons."""

import difflib
import random

import pytest

from siltstone.operators import lint


@pytest.mark.parametrize("ratio", [0.6, 0.9])
def test_bounds_lose_no_match(spark, ratio):
    rng = random.Random(7)
    base = ["concepts/" + "-".join(rng.choice(["chunk", "index", "größe", "route", "x" * 240]) for _ in range(3)) for _ in range(40)]
    known = sorted({b[:k] + rng.choice("ab1é") * rng.randrange(3) + b[k + rng.randrange(3) :] for b in base for k in (rng.randrange(10, len(b)), 12)})
    rows = {tuple(r) for r in lint.best_matches(spark.createDataFrame([(b,) for b in base], "target string"), spark.createDataFrame([(k,) for k in known], "slug string"), ratio).collect()}
    import re

    words = lambda s: {w for w in re.split("[^a-z0-9]+", re.sub("^[a-z]+/", "", s)) if len(w) > 2}
    want = set()
    for t in set(base):
        found = [(-r, k) for k in known if words(t) & words(k) and (r := difflib.SequenceMatcher(None, t, k).ratio()) >= ratio]
        if found:
            want.add((t, min(found)[1], round(-min(found)[0], 6)))
    assert rows == want


def test_pairs_are_bounded_before_python_compares_them(spark):
    df = lint.best_matches(spark.createDataFrame([("a/chunk-x",)], "target string"), spark.createDataFrame([("a/chunk-y",)], "slug string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "ArrowEvalPython" not in plan
