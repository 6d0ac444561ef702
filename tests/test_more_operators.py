"""Hand-made cases of the gates, branches, windows and small readers."""

import json

import pytest
from pyspark.sql import functions as F
from siltstone.functions import text as T
from siltstone.operators import changes, graph, ranking, selection
from siltstone.sources import files, sinks
from siltstone.streaming import pipelines


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def tuples(frame):
    return sorted(tuple(r) for r in frame.collect())


def test_failures_start_anew_with_a_change_or_a_success(spark):
    rows = [
        ("a", "h1", 1, True), ("a", "h1", 2, True), ("b", "h1", 1, True), ("b", "h2", 2, True), ("c", "h1", 1, True), ("c", "h1", 2, False), ("c", "h1", 3, True),
        ("d", "h1", 1, False), ("e", None, 1, True), ("e", None, 2, True), ("f", "h1", 1, True), ("f", "h2", 2, True), ("f", "h1", 3, True), ("g", "h", 1, None),
    ]
    got = changes.failure_counts(df(spark, [(*r, "clash") for r in rows], "k string, d string, o int, f boolean, attempts string"), "k", "d", "o", "f")
    assert {r["k"]: r["attempts"] for r in got.collect()} == {"a": 2, "b": 1, "c": 1, "d": 0, "e": 2, "f": 1, "g": 0}
    now = df(spark, [("a", "h1"), ("b", "h3"), ("c", "h1"), ("z", "h")], "k string, d string")
    assert tuples(changes.retry_gate(now, got, "k", "d", 2)) == [("b", "h3"), ("c", "h1"), ("z", "h")]


def test_branches(spark):
    touched = df(spark, [(1, "x"), (2, "x"), (3, "x"), (1, "y"), (2, "y"), (4, "z"), (5, "z"), (4, "z")], "branch int, path string")
    ancestry = df(spark, [(1, 2), (1, 3)], "ancestor int, branch int")
    assert tuples(changes.conflicts(touched, ancestry)) == [("x", 2), ("z", 2)]
    member = df(spark, [("x", "c"), ("y", "c"), ("z", "d")], "path string, community string")
    # 4 and 5 share one community by one same file only; 1 is an ancestor of 2 and 3
    assert tuples(changes.branch_pairs(touched, member, ancestry)) == [(2, 3, 1)]


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_prefix_with_gaps(spark, block):
    rows = [("g", p, 4) for p in (1, 1000, 10**9, 10**12)] + [("h", 5, 99), ("h", 6, 1), ("g", None, 1)]
    got = selection.prefix_budget(df(spark, rows, "g string, i bigint, n int"), "g", "i", "n", 15, block=block).select("g", "i", "used")
    assert tuples(got) == [("g", 1, 5), ("g", 1000, 10), ("g", 10**9, 15)]


def test_equal_vectors_come_by_key(spark):
    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(99, [0.0, 1.0])]
    e = df(spark, rows, "k bigint, v array<float>").repartition(3)
    got = ranking.vector_search(e, "k", "v", e.where("k in (0, 40)"), k=12).orderBy("query_key", "rank").collect()
    assert [r["key"] for r in got] == [*range(1, 13), *range(12)]


def test_throttle_of_a_batch_honours_the_window(spark):
    rows = [("a", f"2024-01-01 00:{m:02d}:{s:02d}", i) for i, (m, s) in enumerate([(0, 0), (0, 30), (0, 59), (1, 0), (1, 59), (2, 1)])] + [("b", None, 9), (None, "2024-01-01 00:00:00", 8), ("b", "2024-01-01 00:00:00", 7)]
    got = pipelines.throttle(df(spark, rows, "k string, ts string, i int"), "k")
    assert sorted(r["i"] for r in got.collect()) == [0, 3, 5, 7]
    assert pipelines.throttle(df(spark, [], "k string, ts string, i int"), "k").collect() == []


def test_fresh_window(spark):
    turns = df(spark, [("s", i, "x" * 9) for i in range(6)] + [("t", 3, None)], "session_id string, ordinal bigint, text string")
    got = pipelines.fresh_window(turns, df(spark, [("s", 2)], "session_id string, cursor bigint"), 20)
    assert tuples(got.select("session_id", "ordinal")) == [("s", 2), ("s", 3), ("t", 3)]


def test_inheritance_of_any_depth(spark):
    n = 40
    parents = df(spark, [(f"c{i}", f"c{i + 1}") for i in range(n)] + [("l1", "l2"), ("l2", "l1")], "cls string, parent string")
    calls = df(spark, [("s", "c0", "m"), ("s", "l1", "m")], "src string, cls string, method string")
    got = graph.resolve_inherited(calls, df(spark, [(f"c{n}", "m")], "cls string, method string"), parents)
    assert {r["cls"]: r["target"] for r in got.collect()} == {"c0": f"c{n}", "l1": "l1"}


def test_community_labels(spark):
    e = df(spark, [("alpha", "b"), ("b", "cc"), ("alpha", "cc"), ("cc", "dddd"), ("dddd", "b"), ("alpha", "dddd")], "src string, dst string")
    assert {r["label"] for r in graph.communities(e).collect()} == {"b / cc / dddd"}


def test_discovery_and_days(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "s.jsonl").write_text("x" * 7)
    (tmp_path / "a" / "t.txt").write_text("x")
    found = files.discover_sessions(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["length"]) for r in found] == [("s.jsonl", 7)]
    (tmp_path / "2024-01-02.jsonl").write_text("\n".join([json.dumps({"ts": "t", "session_id": s, "tool": "Read", "ok": True}) for s in "ab"] + ["nonsense", "[1]"]))
    assert sorted(r["session_id"] for r in files.tool_events_of(spark, str(tmp_path), "2024-01-02").collect()) == ["a", "b"]
    assert files.tool_events_of(spark, str(tmp_path), "2024-01-03").collect() == []
    with pytest.raises(ValueError):
        files.tool_events_of(spark, str(tmp_path), "../2024")


def test_zones_and_cached_tables(spark, tmp_path):
    rows = df(spark, [("a", "observed", "x"), ("a", "synthesized", " "), ("b", "other", "y")], "slug string, zone string, text string")
    assert tuples(sinks.zone_rows(rows.where("slug = 'a'"))) == [("a", "observed", "x")]
    with pytest.raises(Exception, match="unknown zone other"):
        sinks.zone_rows(rows).collect()
    built, mark = [], tmp_path / "mark"
    cached = sinks.CachedTable(spark, str(mark), lambda: built.append(1) or spark.range(len(built)))
    assert [cached.read().count() for _ in range(2)] == [1, 1] and len(built) == 1
    mark.write_text("x")
    assert cached.read().count() == 2 and len(built) == 2


def test_slim_hits(spark):
    m = F.create_map(F.lit("type"), F.lit("fact"), F.lit("secret"), F.lit("x"), F.lit("zone"), F.lit(None).cast("string"))
    hit = df(spark, [(" a \n b " + "c" * 300, None, "s")], "x string, t string, s string").select(T.slim_hit(F.col("x"), F.col("t"), F.col("s"), m).alias("h")).first()["h"]
    assert hit["title"] == "s" and hit["metadata"] == {"type": "fact"} and hit["snippet"].startswith("a b ccc") and len(hit["snippet"]) == 221


def test_components_that_do_not_settle_raise(spark):
    from siltstone.operators.components import connected_components

    chain = df(spark, [(i, i + 1) for i in range(64)], "src int, dst int")
    assert {r["component"] for r in connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        connected_components(chain, 1)
