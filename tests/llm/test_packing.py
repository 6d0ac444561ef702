import functools
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from siltstone.llm import packing as P

counter_of = functools.lru_cache(P.TokenCounter)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(P.VOCABULARY), reason="no vocabulary file")


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 9), max_size=12))
def test_plan_holds_every_item_once(histogram):
    used = {}
    for sizes, times in P.plan(histogram, 20):
        assert sum(sizes) <= 20 and times > 0
        for s in sizes:
            used[s] = used.get(s, 0) + times
    assert used == histogram


def optimum(sizes, capacity):
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity and bins[j] not in bins[:j]:
                bins[j] += sizes[i]
                place(i + 1, bins)
                bins[j] -= sizes[i]
        bins.append(sizes[i])
        place(i + 1, bins)
        bins.pop()

    place(0, [])
    return best[0]


def test_a_dominating_set_keeps_the_optimum():
    """Fixing the set that the reduction names costs no container, whatever else there is."""
    rng, fixed = random.Random(5), 0
    for _ in range(400):
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(1, 9))), reverse=True)
        open_ = P._Open({s: sizes.count(s) for s in sizes})
        open_.take(sizes[0], 1)
        partners = P._dominating(open_, sizes[0], 20 - sizes[0])
        if partners is not None:
            rest = list(sizes[1:])
            for x in partners:
                rest.remove(x)
            assert sizes[0] + sum(partners) <= 20
            assert 1 + optimum(rest, 20) == optimum(sizes, 20), (sizes, partners)
            fixed += 1
    assert fixed > 200


def test_plans_are_close_to_the_optimum():
    rng, used, best = random.Random(6), 0, 0
    for _ in range(150):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 10))]
        used += sum(k for _, k in P.plan({s: sizes.count(s) for s in sizes}, 20))
        best += optimum(sorted(sizes, reverse=True), 20)
    assert best <= used <= best * 1.03


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fitting = [r for r in rooms if r >= s]
        room = min(fitting) if fitting else capacity
        if fitting:
            rooms.remove(room)
        rooms.append(room - s)
    return len(rooms)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_plans_are_never_worse_than_best_fit(sizes):
    histogram = {s: sizes.count(s) for s in sizes}
    best = best_fit_decreasing(sizes, 60)
    assert sum(k for _, k in P.plan(histogram, 60)) <= best
    assert sum(k for _, k in P._fill(histogram, 60, False)) == best  # bulk steps are those of single items


def test_the_reduction_saves_containers():
    """Instances where dominance beats best fit alone; it is never used where it does not."""
    rng, saved = random.Random(8), 0
    for _ in range(1000):
        sizes = [rng.randrange(8, 40) for _ in range(rng.randrange(4, 40))]
        histogram = {s: sizes.count(s) for s in sizes}
        counts = [sum(k for _, k in P._fill(histogram, 60, r)) for r in (True, False)]
        saved += max(0, counts[1] - counts[0])
    assert saved > 0


def test_bulk_counts_are_quick():
    rng = random.Random(6)
    histogram = {s: rng.randrange(1, 10**6) for s in range(1, 2049)}
    total = sum(s * n for s, n in histogram.items())
    plan = P.plan(histogram)
    assert sum(k for _, k in plan) <= total / 2048 * 1.005 and len(plan) < 40_000


def test_refuses_other_sizes():
    with pytest.raises(ValueError):
        P.plan({21: 1}, 20)


def test_pack(spark):
    rng = random.Random(7)
    sizes = [(i, rng.choice([0, 1, 5, 5, 5, 12, 20, 21, 47, 60])) for i in range(400)] + [(1000, 0), (1001, 20)]
    df = spark.createDataFrame([(d, n, "x", 1) for d, n in sizes], "doc_id bigint, n_tokens bigint, item string, salt int")
    rows = P.pack(df, 20, group=50).collect()
    filled, pieces = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece_no"], r["first_token"], r["n_tokens"]))
        if r["container_id"] >= 0:
            filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["n_tokens"]
    assert max(filled.values()) <= 20 and sorted(filled) == list(range(len(filled)))
    for d, n in sizes:
        p = sorted(pieces[d])
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == n and len(p) == max(1, -(-n // 20))
        assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:], strict=False))
    assert len(filled) <= sum(n for _, n in sizes) / 20 * 1.1
    assert P.pack(df.limit(0), 20).collect() == []
    odd = spark.createDataFrame([(None, 5), (None, None), (2**60 + 1, 25)], "doc_id bigint, n_tokens bigint")
    assert sorted((r["doc_id"] or 0, r["piece_no"], r["n_tokens"]) for r in P.pack(odd, 20).collect()) == [(0, 0, 0), (0, 0, 5), (2**60 + 1, 0, 20), (2**60 + 1, 1, 5)]


@needs_vocabulary
@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab \n\t1.'é　字", max_size=30))
def test_counts_equal_the_encoder(text):
    counter = counter_of(P.VOCABULARY)
    assert counter.count(text) == len(counter.encode(text)) == counter.count(text)


@needs_vocabulary
def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in P.token_counts(df).collect()} == {1: 2, 2: 0, 3: 0}
