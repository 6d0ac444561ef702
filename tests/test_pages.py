"""Graph queries over every page, against brute force on a small corpus."""

import random
from collections import defaultdict

import pytest
from siltstone.plans import registry

TOPICS = ["concepts/lint-suite", "concepts/retry-queue", "concepts/lock-file", "qa/why", "daily/log"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(5)
    rows, edges = [], set()
    for i in range(24):
        topic = TOPICS[i % 5]
        page = f"{topic}-{i}" if i < 20 else None
        to = rng.sample(TOPICS[:4], rng.randint(0, 2)) + ["free words"] * (i % 7 == 0)
        rows.append((i, page and page + ".md", "src", " ".join(f"See [[{t}]]." for t in to)))
        edges |= {(page or f"doc/{i}", t) for t in to}
        if page:
            edges.add((topic, page))
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, path string, source string, text string").write.parquet(str(folder / "documents.parquet"))
    return str(folder), edges


def steps(edges, seed, most):
    out, to, found, at = defaultdict(set), None, {}, {seed}
    for a, b in edges:
        out[a].add(b)
    for depth in range(1, most + 1):
        to = {b for a in at for b in out[a]} - set(found)
        found |= dict.fromkeys(to, depth)
        at = to
    return found


def rows(spark, name, folder):
    return {tuple(r) for r in registry.queries()[name](spark, folder).collect()}


def test_reach_of_pages(spark, corpus):
    folder, edges = corpus
    back = {(b, a) for a, b in edges}
    want = {(s, n, d) for s in TOPICS[:2] for n, d in steps(back, s, 6).items()}
    assert rows(spark, "g06_callers_pages", folder) == want and any(n.startswith("doc/") for _, n, _ in want)
    want = {(s, n, d) for s in TOPICS[:2] for n, d in steps(edges | back, s, 2).items() if n != s}
    assert rows(spark, "g02_neighbours_pages", folder) == want
    assert rows(spark, "g04_path_pages", folder) == {(steps(edges | back, *TOPICS[:1], 12)[TOPICS[1]],)}


def test_cycles_of_pages(spark, corpus):
    folder, edges = corpus
    nodes = {n for e in edges for n in e}
    far = {n: set(steps(edges, n, 50)) for n in nodes}
    want = {(n, min(m for m in nodes if m in far[n] and n in far[m])) for n in nodes if n in far[n]}
    assert want and rows(spark, "g07_cycles_pages", folder) == want


def test_counts_of_pages(spark, corpus):
    folder, edges = corpus
    nodes = {n for e in edges for n in e}
    assert rows(spark, "g15_degrees_pages", folder) == {(n, sum(a == n for a, _ in edges), sum(b == n for _, b in edges)) for n in nodes}
    assert next(iter(rows(spark, "g09_signature_pages", folder)))[0] == len(edges)
    assert len(rows(spark, "k12_graphml_pages", folder)) == len(nodes) + len(edges) + 2


def test_communities_and_bundle_hold_every_page(spark, corpus):
    folder, edges = corpus
    got = [r[1] for r in registry.queries()["g08_communities"](spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == {n for e in edges for n in e}
    assert sum(r[2] for r in rows(spark, "g10_members", folder)) == len(got)
    near = set(steps(edges | {(b, a) for a, b in edges}, TOPICS[0], 3))
    ids = {i for i in range(24) if (f"{TOPICS[i % 5]}-{i}" if i < 20 else f"doc/{i}") in near}
    assert {r[0] for r in rows(spark, "g03_bundle", folder)} == ids


def test_windows_of_a_long_document_leave_room_for_others(spark, tmp_path):
    """One document has more matching windows than a cut of 120 would hold."""
    rows = [(0, "daily/long.md", "retry queue " * 9000)] + [(i, f"qa/p-{i}.md", "one retry among " + "other words " * 20) for i in range(1, 12)]
    spark.createDataFrame(rows, "doc_id long, path string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "retry queue", "type", "x")], "item_id long, question string, question_type string, passage string").write.parquet(str(tmp_path / "benchmark_items.parquet"))
    got = registry.queries()["w11_best_window"](spark, str(tmp_path)).collect()
    assert len(got) == 10 and sorted(r["doc_id"] for r in got) == list(range(10))
