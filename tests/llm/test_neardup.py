import random
import re

import numpy as np
import pytest
from siltstone.llm import neardup as N


def grams(text, width=3):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False))


def brute(rows, threshold=0.5, width=3):
    sets = [(k, grams(t, width)) for k, t in rows]
    return {(min(a, b), max(a, b)) for a, x in sets for b, y in sets if a < b and x and y and len(x & y) / len(x | y) >= threshold}


def corpus(seed, n=90):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.5:
            words = (rng.choice(rows)[1] or "a b c").split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(2)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 40))]
        rows.append((f"k{i:03d}", " ".join(words) or "x"))
    return rows + [("null", None), ("empty", ""), ("short", "two words"), ("again", rows[0][1]), ("same", rows[0][1].upper().replace(" ", ", "))]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in rows] + [(rows[1][0], rows[1][1], "twice", 2)], "key string, text string, id string, gram int")
    got = N.similar_pairs(df).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == brute(rows)


@pytest.mark.parametrize("block", [2, 5, 4096])
def test_blocks_lose_no_candidate(spark, block):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(3, 70))]
    sets = N.text_sets(spark.createDataFrame([(i, t) for i, t in rows], "key bigint, text string")).select(N.F.col("key").alias("id"), "grams")
    sets = sets.dropDuplicates(["grams"])
    have = {r["id"] for r in sets.collect()}
    got = {tuple(sorted(r)) for r in N.candidates(sets, 0.5, block).collect()}
    assert {p for p in brute([r for r in rows if r[0] in have])} <= got


def test_wider_sequences(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "key string, text string")
    assert {tuple(r) for r in N.similar_pairs(df, 0.8, 5).collect()} == brute(rows, 0.8, 5)


def test_groups(spark):
    rows = corpus(5)
    out = {r["key"]: r for r in N.similar_groups(spark.createDataFrame(rows, "key string, text string")).collect()}
    pairs = brute(rows)
    assert set(out) == {k for p in pairs for k in p}
    parent = {k: k for k in out}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in pairs:
        parent[find(a)] = find(b)
    want, got = {}, {}
    for k in out:
        want.setdefault(find(k), set()).add(k)
        got.setdefault(out[k]["group_id"], set()).add(k)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_traversal_keeps_all_pairs_over_the_threshold():
    rng = np.random.default_rng(6)
    sets = [set(rng.choice(400, rng.integers(5, 60), replace=False).tolist()) for _ in range(300)]
    sets += [s | {401 + i} for i, s in enumerate(sets[:40])]
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    maps = np.zeros((len(sets), N.BITS // 64), np.uint64)
    for i, j in enumerate(order):
        for x in sets[j]:
            maps[i, (x * 7919 % N.BITS) // 64] |= np.uint64(1 << (x * 7919 % N.BITS % 64))
    n = sizes[order].astype(np.int64)
    tree = N._tree(N._Level(maps, maps, n, n, n))
    a, b = N.dual_traversal(tree, tree, 0.5, True)
    got = {tuple(sorted((int(order[i]), int(order[j])))) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert want <= got and len(got) < len(sets) * (len(sets) - 1) / 4


def test_a_hot_token_that_few_are_alike_by_makes_no_pairs():
    """A block of texts that share a stretch too short for the threshold ends at the root of its tree."""
    n = np.full(50_000, 110, np.int64)
    maps = np.random.default_rng(1).integers(0, 2**63, (len(n), N.WORDS)).astype(np.uint64)
    tree = N._tree(N._Level(maps, maps, n, np.full(len(n), 60), np.full(len(n), 60)))
    looked = []
    possible = N._Level.possible
    try:
        N._Level.possible = lambda self, a, other, b, t: looked.append(len(a)) or possible(self, a, other, b, t)
        a, b = N.dual_traversal(tree, tree, 0.5, True)
    finally:
        N._Level.possible = possible
    assert len(a) == 0 and sum(looked) == 1


def test_hot_groups_copy_no_row_for_blocks_that_cannot_meet(spark):
    """Texts of one template and own words: every block is ruled out by its summary."""
    rng = random.Random(9)
    template = " ".join(f"t{i}" for i in range(60))
    rows = [(f"k{i}", template + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(70))) for i in range(300)]
    rows += [("x", template + " " + "alike " * 3), ("y", template + " other")]
    df = spark.createDataFrame(rows, "key string, text string")
    sets = N.text_sets(df).select(N.F.col("number").alias("id"), "grams")
    assert N.candidates(sets, 0.5, 16).count() <= 1 and {tuple(r) for r in N.similar_pairs(df).collect()} == {("x", "y")} == brute(rows)


def test_words():
    assert N.sequences("Ein-zwei_drei, VIER").tolist() == N.sequences("ein zwei drei vier").tolist() and len(N.sequences("a b c a b c a b c")) == 3
    assert len(N.sequences(None)) == len(N.sequences("a b")) == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "key string, text string")
    assert N.similar_pairs(df).collect() == [] and N.similar_groups(df).collect() == []
