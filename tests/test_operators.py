"""Operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F
from siltstone.functions import events as E
from siltstone.functions import scoring as S
from siltstone.functions import text as T
from siltstone.operators import changes, chunking, evaluation, graph, joins, lint, ranking, selection
from siltstone.operators.components import connected_components


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("camelCase snake_case X a1 HTTPServer"))) == ["camel", "case", "snake", "case", "a1", "httpserver"]
    assert one(spark, T.tokens(F.lit("!!! ?"))) == []


def test_links(spark):
    text = F.lit("see [[a/b]]{depends_on} and <!-- [[x]] --> [[c]]")
    assert one(spark, T.wikilinks(text)) == ["a/b", "c"]
    assert [tuple(r) for r in one(spark, T.typed_wikilinks(text))] == [("a/b", "depends_on"), ("c", None)]


def test_zones(spark):
    new = "---\ntitle: x\n---\n# T\n\n## Truth\n\n### Observed\n\nseen\n\n### Synthesized\n\nmade\n\n## Timeline\nold"
    assert tuple(one(spark, T.zones(F.lit(new)))) == ("seen", "made")
    assert tuple(one(spark, T.zones(F.lit("## Truth\n\nall of it\n---\nrest")))) == ("all of it", "")
    assert tuple(one(spark, T.zones(F.lit("nothing")))) == ("", "")


def test_fallback_truth(spark):
    text = "# T\n\nIntro here.\n\n## Details\n\n" + " ".join(["w"] * 250) + "\n\n## Related Concepts\n\n- [[a]]\n"
    got = one(spark, T.fallback_truth(F.lit(text)))
    assert got.startswith("Intro here.\n\n### Details (excerpt)\n\nw w") and got.count("w ") == 199 and "...\n\n### Related Concepts\n\n- [[a]]" in got


def test_excerpt_closes_fences(spark):
    got = one(spark, T.excerpt(F.lit("a" * 30 + "\n\n```\ncode " + "b" * 60), F.lit("s"), 50))
    assert got == "a" * 30 + "\n\n(excerpt of s)" or got.count("```") % 2 == 0


def test_heading_sections(spark):
    text = "---\na: 1\n---\n# H1\nintro\n## One\nbody\n### One\nmore\n## Empty\n\n## One\nlast\n"
    rows = chunking.heading_sections(spark.createDataFrame([(1, "d.md", text), (2, "e.md", None), (3, "f.md", "")], "k int, p string, t string"), "k", "p", "t").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in rows] == ["d.md#one", "d.md#one-2", "d.md#one-3"]
    assert {r["chunk"] for r in rows} == {"## One\nbody", "### One\nmore", "## One\nlast"}


def test_windows(spark):
    df = spark.createDataFrame([(1, "x" * 5744), (2, "x" * 5745), (3, ""), (4, None)], "k int, t string")
    n = {r["k"]: r["n"] for r in chunking.char_windows(df, "t", 6000, 256).groupBy("k").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 1, 2: 2}
    w = chunking.word_windows(spark.createDataFrame([(1, "a b c d e")], "k int, t string"), "t", 3, 1).orderBy("part").collect()
    assert [r["window"] for r in w] == ["a b c", "c d e"]
    with pytest.raises(ValueError):
        chunking.word_windows(df, "t", 3, 3)


def test_query_pieces():
    text = "a" * 500 + "\n\n" + "b" * 700
    assert chunking.query_pieces(text) == ["a" * 500, "b" * 700]
    assert len(chunking.query_pieces("x" * 20000)) == 12


def test_bm25_all_negative(spark):
    docs = spark.createDataFrame([(i, "python") for i in range(3)], "d int, t string")
    q = spark.createDataFrame([(1, "python"), (2, "!!!"), (3, None)], "q int, s string")
    hits = ranking.bm25(docs, "d", "t", q, "q", "s", 10).collect()
    assert len(hits) == 3 and all(h["score"] < 0 for h in hits) and [h["d"] for h in sorted(hits, key=lambda h: h["rank"])] == [0, 1, 2]


def test_fusion_counts_a_stream_once(spark):
    s = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (1, 2, "c", 1), (1, 2, "b", 2), (1, 2, "b", 3)], "q int, stream int, id string, rank int")
    r = ranking.fuse(s, "q", "id", 3).orderBy("place").collect()
    assert [x["id"] for x in r] == ["b", "a", "c"] and r[0]["rrf_score"] == round(2 / 62, 8)


def test_vector_search(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0]), (4, None)], "k bigint, v array<float>")
    near = ranking.vector_search(v, "k", "v", v.where("k = 0"), threshold=0.9).collect()
    assert [(r["key"], r["cosine"]) for r in near] == [(1, 1.0)]
    top = ranking.vector_search(v, "k", "v", v.where("k in (0, 2)"), k=2, block=1).collect()
    assert {(r["query_key"], r["key"]) for r in top if r["rank"] == 1} == {(0, 1), (2, 0)}
    assert round(one(spark, ranking.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(0.0)))), 6) == 1.0


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "x", 1)], "q int, d string, rank int")
    gold = spark.createDataFrame([(1, "b"), (2, "y"), (1, "b")], "q int, d string")
    r = {x["q"]: x for x in evaluation.per_question(ranked, gold, "q", "d", 10).collect()}
    assert (r[1]["recall_any"], r[1]["rr"]) == (1.0, 0.5) and r[1]["ndcg"] == 0.63093 and r[2]["ndcg"] == 0.0


@pytest.mark.parametrize("days,low,high", [(0, 0.88, 1.0), (90, 0.40, 0.55), (3650, 0.05, 0.06)])
def test_confidence_decay(spark, days, low, high):
    c = S.confidence(F.lit(0.9), F.lit(1), F.date_sub(F.lit("2026-04-12").cast("date"), days), F.lit("2026-04-12").cast("date"))
    assert low <= one(spark, c) <= high


def test_confidence_defaults(spark):
    at = F.lit("2026-04-12").cast("date")
    assert 0.55 <= one(spark, S.confidence(F.lit(0.9), F.lit(None), F.lit(None).cast("date"), at)) <= 0.85
    assert one(spark, S.recency(F.lit(None).cast("date"), at)) == 0.1


def test_overlap_join(spark):
    rng = random.Random(1)
    a = [(rng.randrange(3), i, s, s + rng.randrange(300)) for i in range(60) for s in [rng.randrange(1000)]]
    b = [(rng.randrange(3), i, s, s + rng.randrange(50)) for i in range(60) for s in [rng.randrange(1000)]]
    left, right = spark.createDataFrame(a, "f int, x int, start int, end int"), spark.createDataFrame(b, "f int, y int, start int, end int")
    got = sorted((r["x"], r["y"]) for r in joins.overlap_join(left, right, "f", 16).collect())
    assert got == sorted((p[1], q[1]) for p in a for q in b if p[0] == q[0] and p[2] <= q[3] and q[2] <= p[3])


def test_asof_join(spark):
    rng = random.Random(2)
    left = [(rng.randrange(3), i, rng.randrange(1000)) for i in range(80)]
    right = [(rng.randrange(3), rng.randrange(1000), i) for i in range(80)]
    out = joins.asof_join(spark.createDataFrame(left, "u int, e int, t bigint"), spark.createDataFrame(right, "u int, t bigint, v int"), "u", "t", 40, "v").collect()
    assert len(out) == 80
    for r in out:
        best = max(((t, v) for u, t, v in right if u == r["u"] and t <= r["t"] and r["t"] - t <= 40), default=(None, None))
        assert (r["right_time"], r["v"]) == best


def test_greedy_budget_skips(spark):
    items = spark.createDataFrame([("p", 0.1, 50, True), ("a", 0.9, 40, False), ("b", 0.8, 30, False), ("c", 0.7, 10, False), ("n", None, None, False)], "k string, s double, z int, pin boolean")
    for page in (1, 2, 100):
        assert [r["k"] for r in selection.greedy_budget(items, "k", "s", "z", 100, "pin", page).orderBy("place").collect()] == ["p", "a", "c", "n"]


def test_prefix_budget(spark):
    rows = spark.createDataFrame([("g", i, 10) for i in range(1, 6)], "g string, i int, n int")
    assert sorted(r["i"] for r in selection.prefix_budget(rows, "g", "i", "n", 25).collect()) == [1, 2]


def test_changes(spark):
    old, new = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "k string, h string"), spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "k string, h string")
    assert {r["k"]: r["change"] for r in changes.classify_changes(old, new, "k", "h").collect()} == {"a": "removed", "b": "changed", "c": "same", "d": "new"}


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def test_components(spark):
    path = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)]
    r = connected_components(edges(spark, path + [("x", "y"), ("z", "z"), (None, "q")])).collect()
    got = {x["node"]: x["component"] for x in r}
    assert len(r) == len(got) == 63 and {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == "x"


def test_reach_and_cycle(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a")])
    seeds = spark.createDataFrame([("a",), ("unknown",)], "seed string")
    assert {(r["node"], r["depth"]) for r in graph.reach(e, seeds, 6, reverse=True).collect()} == {("c", 1), ("x", 1), ("b", 2), ("a", 3)}


def test_trace_marks_cycles(spark):
    t = graph.trace(edges(spark, [("a", "b"), ("b", "a"), ("b", "c")]), spark.createDataFrame([("a",)], "root string"), 6)
    assert {(tuple(r["path"]), r["leaf"]) for r in t.collect()} == {(("a", "b", "a"), "cycle"), (("a", "b", "c"), "end")}


def test_shortest_path(spark):
    e = edges(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")])
    assert [r["node"] for r in graph.shortest_path(e, "a", "e").orderBy("step").collect()] == ["a", "b", "d", "e"]
    assert graph.shortest_path(e, "a", "zz").count() == 0


def test_strong_components(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("x", "a")])
    got = {}
    for r in graph.strong_components(e).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert got == {"a": {"a", "b"}, "c": {"c", "d", "e"}, "f": {"f"}}


def test_communities(spark):
    e = edges(spark, [("A", "B"), ("B", "C"), ("A", "C"), ("C", "D"), ("D", "E"), ("E", "F"), ("D", "F"), ("G", "G")])
    member = graph.communities(e)
    got = {}
    for r in member.collect():
        got.setdefault(r["community_id"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [["A", "B", "C"], ["D", "E", "F"]]
    assert graph.modularity(e, member).first()["modularity"] > 0.3
    star = graph.communities(edges(spark, [("H", f"s{i}") for i in range(5)]))
    assert {r["hub"] for r in star.collect()} == {"H"}


def test_lint_fixers():
    fix = lint.FIXERS
    kind = fix["missing_memory_type"]
    typed = kind("a/decision-1.md", "---\ntitle: x\n---\nbody", None, None)
    assert typed == "---\ntitle: x\ntype: decision\n---\nbody" == kind("a/decision-1.md", typed, None, None)
    assert kind("a/feedback_x.md", "---\n---\n", None, None) == "---\ntype: preference\n---\n"
    for path, text in (("a/decision-1.md", "---\ntype: odd\n---\nx"), ("a/other-1.md", "---\n---\n"), ("a/event-1.md", "no block")):
        assert kind(path, text, None, None) == text
    for name, mark, comment in (("broken_link", "[[{}]]", lint.BROKEN_LINK), ("broken_source_anchor", "[src:{}]", lint.BROKEN_ANCHOR)):
        old = mark.format("a")
        wrapped = fix[name]("p", f"see {old} and {old}", "a", None)
        assert wrapped == f"see {comment.format(old)} and {comment.format(old)}" == fix[name]("p", wrapped, "a", None)
        half = fix[name]("p", f"{wrapped} then {old}", "a", None)
        assert half == f"{wrapped} then {comment.format(old)}"
        assert fix[name]("p", f"see {old}", "a", "b") == f"see {mark.format('b')}" and fix[name]("p", "see", "a", "b") == "see"
    back = fix["missing_backlink"]
    linked = back("p", "---\nt: 1\n---\n## Truth\n\nx\n\n---\n\n## Timeline\ny\n", "b", None)
    assert linked == "---\nt: 1\n---\n## Truth\n\nx\n\n### Related Concepts\n\n- [[b]] - Auto-added backlink\n\n---\n\n## Timeline\ny\n" == back("p", linked, "b", None)
    more = back("p", linked, "c", None)
    assert "- [[b]] - Auto-added backlink\n- [[c]] - Auto-added backlink\n" in more
    assert back("p", "body", "b", None) == "body\n\n### Related Concepts\n\n- [[b]] - Auto-added backlink\n"
    assert lint.add_related_links("see [[a]]", ["a", "b", "c"]).endswith("### Related Concepts\n\n- [[b]]\n- [[c]]\n")


PAGES = [
    ("concepts/a.md", "concepts/a", "---\ntype: fact\nupdated: 2025-01-01\n---\n[[concepts/b]]{depends_on} [[concepts/bb]]{odd} [src:daily/x.md] [src:daily/gone.md]"),
    ("concepts/b.md", "concepts/b", "---\ntype: odd\npinned: true\nupdated: 2020-01-01\n---\n" + "word " * 200),
    ("concepts/decision-c.md", "concepts/decision-c", "---\ntitle: c\n---\n[[concepts/topic-one-lonh]] [[daily/z]]"),
    ("concepts/topic-one-long.md", "concepts/topic-one-long", "[[concepts/a]] <!-- [[concepts/no]] -->"),
]


def lint_corpus(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return lint.Corpus(
        pages=df(PAGES, "path string, slug string, text string"), files=df([("daily/x.md",)], "path string"),
        logs=df([("l1", "h1"), ("l2", "h2"), ("l3", "h3")], "name string, hash string"), compiled=df([("l1", "h1"), ("l2", "old")], "name string, hash string"),
        declared=df([("g/s1",), ("g/s2",)], "key string"), ingested=df([("g/s1",)], "key string"), indexed=df([("concepts/a",), ("concepts/old",), ("concepts/old",)], "slug string"),
        similar=df([("a", "b", 0.99), ("a", "c", 0.9)], "slug_a string, slug_b string, cosine double"), accesses=df([("concepts/x", 3), ("concepts/a", 0)], "slug string, n bigint"), today="2026-01-01",
    )


ISSUES = {
    ("error", "broken_link", "concepts/a.md", "concepts/bb"), ("error", "broken_link", "concepts/decision-c.md", "concepts/topic-one-lonh"),
    ("warning", "orphan_page", "concepts/decision-c.md", "concepts/decision-c"), ("warning", "orphan_page", "concepts/topic-one-long.md", "concepts/topic-one-long"),
    ("warning", "orphan_source", "l3", "l3"), ("warning", "orphan_source_file", "g/s2", "g/s2"), ("warning", "stale_article", "l2", "l2"),
    ("suggestion", "missing_backlink", "concepts/a.md", "concepts/b"), ("suggestion", "missing_backlink", "concepts/topic-one-long.md", "concepts/a"),
    ("suggestion", "sparse_article", "concepts/a.md", "4"), ("suggestion", "sparse_article", "concepts/decision-c.md", "2"), ("suggestion", "sparse_article", "concepts/topic-one-long.md", "4"),
    ("suggestion", "missing_source_anchor", "concepts/b.md", "no anchors"), ("suggestion", "missing_source_anchor", "concepts/decision-c.md", "no anchors"), ("suggestion", "missing_source_anchor", "concepts/topic-one-long.md", "no anchors"),
    ("error", "broken_source_anchor", "concepts/a.md", "daily/gone.md"), ("error", "invalid_wikilink_relation", "concepts/a.md", "[[concepts/bb]]{odd}"),
    ("error", "invalid_memory_type", "concepts/b.md", "odd"), ("suggestion", "missing_memory_type", "concepts/decision-c.md", "no type"), ("suggestion", "missing_memory_type", "concepts/topic-one-long.md", "no type"),
    ("error", "near_duplicate", "a", "b (cosine 0.990)"), ("warning", "near_duplicate", "a", "c (cosine 0.900)"), ("warning", "stale_vector", "concepts/old", "concepts/old"),
}


def test_all_checks(spark):
    assert len(lint.CHECKS) == 13
    got = {tuple(r)[:4] for r in lint.report(lint_corpus(spark)).collect()}
    low = {g for g in got if g[1] == "low_priority_article"}
    assert got - low == ISSUES and [(g[0], g[2]) for g in low] == [("suggestion", "concepts/a.md")] and "365 days, 1 links" in next(iter(low))[3]
    with pytest.raises(ValueError):
        lint.report(lint_corpus(spark), ["odd"])


def test_fixes_over_a_table(spark):
    c = lint_corpus(spark)
    issues = lint.report(c)
    fixed = {r["path"]: r for r in lint.apply_fixes(c.pages, issues, files=c.files).collect()}
    a = fixed["concepts/a.md"]
    assert (a["fixed"], a["attempted"]) == (3, 3)  # a link, an anchor, a backlink
    assert "<!-- BROKEN-LINK: [[concepts/bb]] -->" in a["text"] and "<!-- BROKEN-SRC: [src:daily/gone.md] -->" in a["text"] and "- [[concepts/topic-one-long]] - Auto-added backlink" in a["text"]
    assert "[[concepts/topic-one-long]]" in fixed["concepts/decision-c.md"]["text"] and "type: decision" in fixed["concepts/decision-c.md"]["text"]
    pages = spark.createDataFrame([(p, s, fixed[p]["text"] if p in fixed else t) for p, s, t in PAGES], c.pages.schema)
    again = lint.apply_fixes(pages, lint.report(lint.Corpus(pages, c.files)), files=c.files).collect()
    assert sum(r["fixed"] for r in again) == 1  # the link put right in the first run misses its backlink now
    assert {tuple(r) for r in lint.fix_stale(c.compiled, issues).collect()} == {("l1", "h1"), ("l2", "")}
    assert lint.apply_fixes(c.pages, issues, ["sparse_article"]).collect() == []


def test_contradictions_and_crosslinks(spark):
    replies = spark.createDataFrame([("CONTRADICTION: [concepts/a] vs [[concepts/b.md]] - they differ\nnone",), (None,), ("- INCONSISTENCY: `concepts/c.md` and concepts/d",)], "reply string")
    assert {(r["file"], r["argument"]) for r in lint.contradictions(replies).collect()} == {("concepts/a.md", "concepts/b"), ("concepts/c.md", "concepts/d")}
    articles = spark.createDataFrame([(1, "concepts/lock", "Lock File", ["LF", "the lock"]), (2, "concepts/other", "lock file", None), (3, "concepts/map", "Community Map", None)], "seq int, slug string, title string, aliases array<string>")
    index = lint.title_index(articles)
    assert {tuple(r) for r in index.collect()} == {("lock file", "concepts/lock"), ("the lock", "concepts/lock"), ("community map", "concepts/map")}
    pages = spark.createDataFrame([("p.md", "p", "a Community Map and the lock file"), ("q.md", "q", "[[concepts/map]] community map `lock file`"), ("concepts/lock.md", "concepts/lock", "the lock file")], "path string, slug string, text string")
    got = {r["path"]: (r["n_links"], r["text"]) for r in lint.crosslinked(pages, index).collect()}
    assert got == {"p.md": (2, "a Community Map and the lock file\n\n### Related Concepts\n\n- [[concepts/map]]\n- [[concepts/lock]]\n")}


def test_masked_prose():
    text = "---\na\n---\nuse `x` and [[y]]\n"
    assert len(lint.mask_non_prose(text)) == len(text) and lint.mask_non_prose(text).split() == ["use", "and"]


def test_event_projections(spark):
    d = E.input_digest(F.lit("Bash"), F.lit('{"command": "ls\\nrm x", "secret": "no", "description": "list"}'))
    assert one(spark, d) == {"command": "ls", "description": "list"}
    assert one(spark, E.event_label(F.lit("Bash"), d)) == "Bash: ls"
    assert one(spark, E.response_ok(F.lit('{"is_error": true}'))) is False and one(spark, E.response_ok(F.lit("plain"))) is True
    assert one(spark, E.validated_list(F.lit('```json\n["a", " ", "b"]\n```'))) == ["a", "b"]
    assert one(spark, E.validated_list(F.lit("no json"))) == []
    assert [tuple(r) for r in one(spark, E.rationale(F.lit("// TODO: later\n# @Deprecated use x\n// todo no")))] == [("TODO", "later"), ("DEPRECATED", "use x")]


def test_inheritance(spark):
    calls = spark.createDataFrame([("s", "C", "m"), ("s", "C", "n"), ("s", "L", "m")], "src string, cls string, method string")
    methods = spark.createDataFrame([("A", "m")], "cls string, method string")
    parents = spark.createDataFrame([("C", "B"), ("B", "A"), ("L", "L2"), ("L2", "L")], "cls string, parent string")
    got = {(r["cls"], r["method"]): r["target"] for r in graph.resolve_inherited(calls, methods, parents).collect()}
    assert got == {("C", "m"): "A", ("C", "n"): "C", ("L", "m"): "L"}


def test_coarse_index_recall(spark, small):
    e = spark.read.parquet(f"{small}/embeddings.parquet")
    q = e.where("vec_id % 20 = 0")
    exact = {(r["query_key"], r["key"]) for r in ranking.vector_search(e, "vec_id", "embedding", q, k=5).collect()}
    near = {(r["query_key"], r["key"]) for r in ranking.cell_search(e, "vec_id", "embedding", q, 5, ranking.fit_cells(e, "vec_id", "embedding", 16), 12).collect()}
    assert len(exact & near) >= 0.9 * len(exact) > 0


def test_mentions(spark):
    t = spark.createDataFrame([(1, "see the Lint Suite (old) now"), (2, None), (3, "linting")], "k int, t string")
    n = spark.createDataFrame([("lint suite",), ("Lint",), ("old",), (None,)], "name string")
    assert {(r["k"], r["name"], r["position"]) for r in joins.mentions(t, "k", "t", n).collect()} == {(1, "lint suite", 9), (1, "lint", 9)}


def test_search_entry(spark):
    from siltstone.operators.search import search

    docs = spark.createDataFrame([(1, "retry queue"), (2, "retry lock"), (3, "other words"), (4, None)], "d int, t string")
    q = spark.createDataFrame([(7, "retry queue")], "q int, s string")
    for mode in ("lexical", "vector", "hybrid"):
        hits = search(docs, "d", "t", q, "q", "s", 2, mode).orderBy("rank").collect()
        assert [h["d"] for h in hits] == [1, 2], mode
    assert [h["d"] for h in search(docs, "d", "t", q, "q", "s", 2, "lexical", docs.where("d = 2")).collect()] == [2]
    with pytest.raises(ValueError):
        search(docs, "d", "t", q, "q", "s", 2, "odd")
    with pytest.raises(ValueError):
        search(docs, "d", "t", q, "q", "s", 0)
