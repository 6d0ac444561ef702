"""Sources, sinks, code scanners and streams on small files."""

import json

import pytest
from pyspark.sql import functions as F
from siltstone.sources import code, files, sinks
from siltstone.streaming import pipelines

PHP = """<?php
namespace App\\Controller;

use App\\Service\\Mailer;
use App\\Repository\\UserRepository as Users;

#[Route('/user')]
class UserController extends Base
{
    public function __construct(private Mailer $mailer, private Users $users) {}

    // WHY: one query only
    #[Route('/{id}', name: 'user_show', methods: ['GET', 'POST'])]
    public function show(int $id)
    {
        $u = $this->users->find($id); // "}" in a comment
        $this->helper();
        $this->mailer->send('x } y');
        return $this->render('user/show.html.twig');
    }

    private function helper()
    {
        return self::make();
    }

    public static function make() { return parent::build(); }
}
"""


def test_markdown_articles(spark, tmp_path):
    root = tmp_path / "concepts"
    root.mkdir()
    (root / "a.md").write_text('---\ntitle: "A title"\nconfidence: high\nsources:\n  - one\n  - two\n---\n# A\n\n## Truth\n\nseen\n')
    (root / "b.md").write_text("no frontmatter")
    (root / "c.txt").write_text("ignored")
    rows = {r["slug"]: r for r in files.articles(spark, [str(root)]).collect()}
    assert set(rows) == {"concepts/a", "concepts/b"} and rows["concepts/b"]["title"] == "b"
    a = rows["concepts/a"]
    assert (a["title"], a["confidence"], a["source_count"], a["observed"]) == ("A title", None, 2, "seen")


def test_globs_and_groups(spark):
    f = spark.createDataFrame([("docs/a.md",), ("docs/x/b.md",), ("docs/x/draft-b.md",), ("src/c.php",)], "path string")
    assert {r["path"] for r in files.glob_rows(f, ["docs/**/*.md"], ["draft-*"]).collect()} == {"docs/a.md", "docs/x/b.md"}
    g = files.source_groups(spark, {"version": 1, "sources": [{"id": "a", "type": "markdown", "include": ["*.md"]}, {"id": "b"}]})
    assert [r["id"] for r in g.collect()] == ["a"]
    with pytest.raises(ValueError):
        files.source_groups(spark, {"version": 2})
    assert "markdown" in files.HANDLERS


def test_transcripts_and_events(spark, tmp_path):
    lines = [
        json.dumps({"timestamp": "t1", "message": {"role": "user", "content": "hi"}}),
        "not json",
        json.dumps({"message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "x"}, {"type": "text", "text": "b"}]}}),
        json.dumps({"role": "user", "content": "flat"}),
        json.dumps({"message": {"role": "system", "content": "no"}}),
        "[1]",
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(lines) + "\n\n")
    got = files.transcript_lines(files.read_lines(spark, str(tmp_path / "t.jsonl"))).orderBy("line_no").collect()
    assert [(r["line_no"], r["role"], r["text"]) for r in got] == [(1, "user", "hi"), (3, "assistant", "a\nb"), (4, "user", "flat")]
    events = [json.dumps({"ts": "1", "session_id": "A", "tool": "Edit", "input": {"file_path": "x"}, "ok": True}), "{bad", "[]", ""]
    (tmp_path / "e.jsonl").write_text("\n".join(events))
    assert [(r["session_id"], r["tool"], r["ok"]) for r in files.tool_events(spark, str(tmp_path / "e.jsonl")).collect()] == [("A", "Edit", True)]


def test_agent_dialects(spark):
    typed = [(1, "p", json.dumps({"type": "summary", "sessionId": ""})), (2, "p", json.dumps({"type": "user", "sessionId": "s1", "cwd": "/w", "timestamp": "T", "message": {"role": "user", "content": "q"}})), (3, "p", json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"text": "r"}]}}))]
    r = files.agent_sessions(spark.createDataFrame(typed, "line_no int, path string, value string"), "typed").first()
    assert (r["session_id"], r["cwd"], r["started_at"]) == ("s1", "/w", "T") and [(t["role"], t["text"]) for t in r["turns"]] == [("user", "q"), ("assistant", "r")]


def test_git(spark):
    log = ["commit\tabc\tann@x\t2024-01-01\tFix it", "3\t1\tsrc/a.php", "-\t-\timg.png", "", "commit\tdef\tbob@x\t2024-01-02\tMore", "1\t0\tsrc/b.php"]
    df = spark.createDataFrame([("log", i, v) for i, v in enumerate(log)], "path string, line_no int, value string")
    assert {(r["sha"], r["file"], r["added"], r["deleted"]) for r in files.git_log(df).collect()} == {("abc", "src/a.php", 3, 1), ("abc", "img.png", 0, 0), ("def", "src/b.php", 1, 0)}
    diff = ["+++ b/src/a.php", "@@ -1,2 +3,4 @@ x", "@@ -9 +12,0 @@", "+++ b/x.js", "@@ -1 +1 @@"]
    hunks = files.diff_hunks(spark.createDataFrame([("d", i, v) for i, v in enumerate(diff)], "path string, line_no int, value string")).orderBy("start").collect()
    assert [tuple(r) for r in hunks] == [("src/a.php", 3, 6), ("src/a.php", 12, 12)]


def test_archive(spark):
    old, new = spark.createDataFrame([("a", "xy"), ("b", "xy"), ("c", "xy")], "k string, t string"), spark.createDataFrame([("a", "xyz"), ("b", "x"), ("c", "q"), ("d", "n")], "k string, t string")
    assert {r["k"]: r["action"] for r in files.archive_state(old, new, "k", "t").collect()} == {"a": "replace", "b": "keep", "c": "diverged", "d": "replace"}


def test_php_facts(spark):
    f = spark.createDataFrame([("src/Controller/UserController.php", PHP), ("src/Service/Mailer.php", "<?php\nnamespace App\\Service;\nclass Mailer {}"), ("n.php", None)], "path string, text string")
    facts = code.php_facts(f).collect()
    me = "App\\Controller\\UserController"
    assert {r["a"] for r in facts if r["kind"] == "symbol"} == {f"{me}::{m}" for m in ("__construct", "show", "helper", "make")}
    calls = {(r["a"].split("::")[1], r["b"], r["c"]) for r in facts if r["kind"] == "edge"}
    assert calls == {
        ("show", "App\\Repository\\UserRepository::find", "call"), ("show", f"{me}::helper", "call"), ("show", "App\\Service\\Mailer::send", "call"), ("show", "template:user/show.html.twig", "render"),
        ("helper", f"{me}::make", "call"), ("make", "App\\Controller\\Base::build", "call"),
    }
    assert [(r["a"], r["b"], r["c"]) for r in facts if r["kind"] == "route"] == [("/user/{id}", f"{me}::show", "GET,POST")]
    table = code.php_facts(f)
    why = code.assign_rationale(table.where("kind = 'rationale' and path like 'src/C%'"), table.where("kind = 'symbol'")).collect()
    assert [r["symbol"] for r in why] == [f"{me}::show"]
    nodes = code.php_nodes(f)
    assert {r["type"] for r in nodes.collect()} == {"controller", "service"}
    assert [tuple(r) for r in code.php_edges(nodes).collect()] == [("src/Controller/UserController.php", "src/Service/Mailer.php")]


def test_templates_and_scripts(spark):
    t = spark.createDataFrame([("a.twig", "{% extends 'base.twig' %}{% include \"p.twig\" %}<div data-controller='x  y'>{{ stimulus_controller('z') }}")], "path string, text string")
    twig = code.twig_templates(t)
    r = twig.first()
    assert (r["extends"], r["includes"], sorted(r["controllers"])) == ("base.twig", ["p.twig"], ["x", "y", "z"])
    assert {x["path"]: x["n_users"] for x in code.included_by(twig).collect()} == {"base.twig": 1, "p.twig": 1}
    js = spark.createDataFrame([("assets/controllers/x_controller.js", "fetch(`/user/${id}?a=1`, {method: 'POST'})\nfetch('/list')"), ("assets/controllers/o_controller.js", "")], "path string, text string")
    states = {x["name"]: x["state"] for x in code.stimulus_controllers(js, twig).collect()}
    assert states == {"x": "used", "o": "orphan", "y": "missing", "z": "missing"}
    routes = spark.createDataFrame([("/user/{id}", ["GET", "POST"], "f", "show")], "path string, methods array<string>, file string, action string")
    assert {(x["url"], x["action"]) for x in code.match_fetches(code.fetches(js), routes).collect()} == {("/user/*", "show"), ("/list", None)}


def test_code_chunks(spark):
    big = "<?php\nclass A\n{\n" + "".join(f"    public function m{i}()\n    {{\n" + "        $x = 1;\n" * 60 + "    }\n" for i in range(9)) + "}\n"
    spans = code.code_chunks(big)
    total = big.count("\n") + 1
    covered = [n for a, b in spans for n in range(a, b + 1)]
    assert set(covered) == set(range(1, total + 1)) and all(b - a + 1 <= 400 for a, b in spans) and len(spans) >= 9
    assert code.code_chunks("x\n" * 400)[0] == (1, 150)
    rows = code.chunk_files(spark.createDataFrame([("a.php", big), ("e.php", ""), ("n.php", None)], "path string, text string")).collect()
    assert {r["path"] for r in rows} == {"a.php"} and "A" in rows[0]["symbols"]


def test_generations(spark, tmp_path):
    t = sinks.GenerationTable(spark, str(tmp_path / "t"), "k")
    assert t.read() is None
    mk = lambda rows: spark.createDataFrame(rows, "k string, v int")
    t.upsert(mk([("a", 1), ("b", 1)]))
    t.upsert(mk([("b", 2), ("c", 3)]))
    t.delete(mk([("a", 0)]))
    assert {tuple(r) for r in t.read().collect()} == {("b", 2), ("c", 3)}
    with pytest.raises(ValueError):
        t.upsert(mk([("x", 1), ("x", 2)]))
    assert t.read().count() == 2


@pytest.mark.parametrize("step", ["create", "rename", "write"])
def test_a_crash_between_the_steps_loses_nothing(spark, tmp_path, step, monkeypatch):
    """A writer that dies at any step leaves readers the last generation, and the next writer goes on from it."""
    mk = lambda rows: spark.createDataFrame(rows, "k string, v int")
    t = sinks.GenerationTable(spark, str(tmp_path / "t"), "k")
    t.upsert(mk([("a", 1)]))
    real = sinks.GenerationTable._fs

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            if name == step:
                raise RuntimeError("killed")
            return getattr(self.fs, name)

    dead = sinks.GenerationTable(spark, str(tmp_path / "t"), "k")
    if step == "write":
        monkeypatch.setattr(dead, "_point", lambda name: (_ for _ in ()).throw(RuntimeError("killed")))
    else:
        monkeypatch.setattr(dead, "_fs", lambda: Broken(real(dead)))
    with pytest.raises(RuntimeError):
        dead.upsert(mk([("b", 2)]))
    assert {tuple(r) for r in t.read().collect()} == {("a", 1)}
    t.upsert(mk([("c", 3)]))
    t.upsert(mk([("d", 4)]))
    assert {tuple(r) for r in t.read().collect()} == {("a", 1), ("c", 3), ("d", 4)} and len(t._pointers()) == 2


def test_staged_replace(spark, tmp_path):
    mk = lambda rows: spark.createDataFrame(rows, "k string, f string")
    t = sinks.GenerationTable(spark, str(tmp_path / "t"), "k")
    t.promote(t.stage(mk([("1", "a"), ("2", "a"), ("3", "b")])), "f")
    staged = t.stage(mk([("4", "a")]))
    assert t.read().count() == 3  # nobody sees a stage
    t.promote(staged, "f")
    assert {tuple(r) for r in t.read().collect()} == {("4", "a"), ("3", "b")}
    with pytest.raises(ValueError):
        t.promote(t.stage(mk([("3", "a")])), "f")  # a key of another file
    t.rollback(t.stage(mk([("9", "z")])))
    assert {tuple(r) for r in t.read().collect()} == {("4", "a"), ("3", "b")} and not list((tmp_path / "t").glob("staged-*"))


def test_batches_events_and_logs(spark, tmp_path):
    seen = tmp_path / "seen"
    seen.mkdir()

    def put(rows, folder=str(seen)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").write(str(len(rows)))

    assert sinks.upsert_batches(spark.range(1000).repartition(2), put) == 1000
    sizes = [int(f.read_text()) for f in seen.iterdir()]
    assert sum(sizes) == 1000 and max(sizes) == 256
    e = spark.createDataFrame([("2024-01-01T10:00", "x"), ("2024-01-02T10:00", "y")], "ts string, tool string")
    sinks.append_events(e, str(tmp_path / "e"))
    sinks.append_events(e.limit(1), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 3
    d = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b")], "name_hash string, text string")
    assert [sinks.write_once(d, str(tmp_path / "d")) for _ in range(2)] == [2, 0]
    logs, index = str(tmp_path / "logs"), str(tmp_path / "index")
    chunk = lambda df: df.select("day", F.explode(F.split("text", "\n\n")).alias("chunk"))
    bad = lambda df: df.select("day", F.raise_error(F.lit("no embedder")).cast("string").alias("chunk"))
    entry = lambda day, text: spark.createDataFrame([(day, text)], "day string, text string")
    assert sinks.append_logs(entry("2024-01-01", "one"), logs, index, chunk)
    assert not sinks.append_logs(entry("2024-01-01", "two"), logs, index, bad)
    assert sinks.append_logs(entry("2024-01-02", "three"), logs, index, chunk)  # and makes up for the day before
    assert {(str(r["day"]), r["chunk"]) for r in spark.read.parquet(f"{index}/chunks").collect()} == {("2024-01-01", "one"), ("2024-01-01", "two"), ("2024-01-02", "three")}


def test_reports(spark):
    lines = lambda df: [r["line"] for r in df.collect()]
    trace = spark.createDataFrame([(["a", "b", "a"], "cycle"), (["a", "c"], "end")], "path array<string>, leaf string")
    got = lines(sinks.mermaid_trace(trace))
    assert got[0] == "flowchart TD" and len(got) == 5 and sum("(cycle)" in x for x in got) == 1 and sum("-->" in x for x in got) == 3
    impact = spark.createDataFrame([("route", "/x", 1.5, "A::m", 2), ("script", "js:y", None, "A::m", 3)], "kind string, name string, risk double, symbol string, depth int")
    got = lines(sinks.mermaid_impact(impact))
    assert len(got) == 3 and any("risk 1.5" in x and "-->|2|" in x for x in got) and any("-.->|3|" in x for x in got)
    n, e = spark.createDataFrame([("a<",), ("b",)], "id string"), spark.createDataFrame([("a<", "b")], "src string, dst string")
    assert json.loads("".join(lines(sinks.graph_json(n, e)))) == {"nodes": [{"id": "a<"}, {"id": "b"}, None], "edges": [{"from": "a<", "to": "b"}, None]}
    assert "<td>a&lt;</td><td>b</td>" in "".join(lines(sinks.graph_html(n, e)))
    schema = "id string, passed boolean, missing array<string>, forbidden array<string>, answer string, error string"
    got = lines(sinks.canary_report(spark.createDataFrame([("a", True, [], [], "x", None), ("b", False, ["m"], ["f"], "l1\nl2", None), ("c", None, [], [], None, "down")], schema), "2024-01-01"))
    assert got == ["# Canary Report - 2024-01-01", "**Total:** 3 canaries | Passed: 1 | Failed: 1 | Errored: 1", "## Errored Canaries", "- **c**: down", "## Failed Canaries", "### b\n\n**Missing substrings:** m\n\n**Forbidden substrings matched:** f\n\n> l1\n> l2", "## Passed Canaries", "- a"]
    scores = spark.createDataFrame([("a", 0.9, 3, 0, 0, None), ("b", 0.1, 0, 1, 2, "x|y"), ("c", 0.5, 1, 1, 0, None)], "slug string, score double, useful bigint, dead_end bigint, corrected bigint, last_note string")
    assert lines(sinks.lessons(scores)) == ["## Contested (1)", "| [[b]] | 0.10 | 2 | 1 | 0 | x\\|y |", "## Trusted (1)", "| [[a]] | 0.90 | 3 | 0 | 0 |"]
    near = spark.createDataFrame([("a", None, 0.5), ("b", "B", 0.9), ("c", None, None)], "slug string, title string, similarity double")
    assert lines(sinks.preflight_block(near)) == ["## Closest existing articles (possible duplicates)", "- `b` (similarity 0.90) - B", "- `a` (similarity 0.50)", "- `c` (similarity ?)"] and lines(sinks.preflight_block(near.limit(0))) == []
    whole = sinks.whole_content(spark.createDataFrame([("idx",)], "text string"), spark.createDataFrame([("qa/a.md", "1"), ("concepts/z.md", "2"), ("daily/x.md", "3")], "path string, text string"))
    assert [r["part"] for r in whole.collect()] == ["## INDEX\n\nidx", "## concepts/z.md\n\n2", "## qa/a.md\n\n1"]


def test_partitions_and_state(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 1)], "f string, v int"), path, "f")
    sinks.replace_partitions(spark.createDataFrame([("b", 2)], "f string, v int"), path, "f")
    assert {(r["f"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("b", 2)}
    old, new = spark.createDataFrame([("a", 1, "x")], "k string, n int, s string"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, n int")
    assert {tuple(r) for r in sinks.merge_state(old, new, "k").collect()} == {("a", 2, "x"), ("b", 3, None)}


def test_exports(spark):
    e, n = spark.createDataFrame([('a"', "b")], "src string, dst string"), spark.createDataFrame([('a"',), ("b",)], "id string")
    assert [r["line"] for r in sinks.graphml(n, e).collect()][1] == '<node id="a&quot;"/>'
    assert "MERGE" in sinks.cypher(n, e).first()["line"] and sinks.mermaid(e).count() == 2


def test_debounce_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "article", "a"), ("2024-01-01 00:00:01.5", "article", "b"), ("2024-01-01 00:00:30", "article", "c"), ("2024-01-01 00:10:00", "daily", "z")]
    src = spark.createDataFrame(rows, "ts string, kind string, path string").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    out = pipelines.run_available(pipelines.debounce(stream), str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert sorted((r["kind"], r["n_changes"]) for r in out) == [("article", 1), ("article", 2)]
    assert pipelines.debounce(src).count() == 3


def test_debounce_keeps_every_path(spark):
    rows = [(f"2024-01-01 00:00:00.{i % 1000:03d}", "article", f"p{i % 3000:04d}") for i in range(6000)]
    r = pipelines.debounce(spark.createDataFrame(rows, "ts string, kind string, path string")).first()
    assert r["n_changes"] == 6000 and r["n_paths"] == 3000 and r["paths"] == [f"p{i:04d}" for i in range(3000)]


def test_cursor_stream(spark, tmp_path):
    schema = "session_id string, ordinal bigint, text string"
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    run = lambda: pipelines.run_available(pipelines.fresh_turns(spark.readStream.schema(schema).parquet(src)), out, cp)
    spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], schema).write.parquet(src)
    assert run().count() == 2
    spark.createDataFrame([("s", 0, "a"), ("s", 1, "b"), ("s", 2, "c"), ("t", 0, "x")], schema).write.mode("append").parquet(src)
    assert sorted((r["session_id"], r["ordinal"]) for r in run().collect()) == [("s", 0), ("s", 1), ("s", 2), ("t", 0)]


def test_throttle_and_batch_sink(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:00:10"), ("b", "2024-01-01 00:00:00")], "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    s = pipelines.throttle(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k")
    assert pipelines.run_available(s, str(tmp_path / "out"), str(tmp_path / "cp")).count() == 2
    q = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(pipelines.replace_changed("k", str(tmp_path / "sink"))).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3


def test_queue(spark):
    jobs = spark.createDataFrame([(1, 100, 0, 0, "x"), (2, 50, 990, 0, "x"), (3, 10, 0, 5, "x"), (4, None, 0, 0, "x"), (5, 1, 0, 0, None)], "job_id int, created_at bigint, spawned_at bigint, attempts int, context string")
    assert {r["job_id"]: r["state"] for r in pipelines.lease_queue(jobs, 1000).collect()} == {1: "ready", 2: "leased", 3: "exhausted", 4: "corrupt", 5: "corrupt"}


def test_benchmark_questions(spark, tmp_path):
    from siltstone.sources import benchmark

    good = {"question_id": "q1", "question": "who?", "question_type": "t", "haystack_session_ids": ["s1", "s2", "s1"], "haystack_sessions": [[{"role": "user", "content": "a"}], [{"role": None, "content": " "}], [{"role": "user", "content": "a"}]], "answer_session_ids": ["s1"]}
    (tmp_path / "b.json").write_text(json.dumps([good]))
    q, h = benchmark.questions(spark, str(tmp_path / "b.json"))
    assert [r["gold"] for r in q.collect()] == [["s1"]] and {(r["session_id"], r["text"]) for r in h.collect()} == {("s1", "user: a"), ("s2", "unknown:  ")}
    for change in ({"answer_session_ids": []}, {"answer_session_ids": ["zz"]}, {"question": " "}, {"haystack_session_ids": ["s1"]}):
        (tmp_path / "bad.json").write_text(json.dumps([good | change]))
        with pytest.raises(Exception, match="not sound"):
            benchmark.questions(spark, str(tmp_path / "bad.json"))[0].collect()


def test_canaries(spark):
    from siltstone.sources import benchmark

    checks = benchmark.canaries(spark, [{"id": "a", "question": "q", "must_contain": ["Blue"], "must_not_contain": ["red"]}, {"id": "b", "question": "q", "must_contain": ["x"]}])
    got = {r["id"]: (r["passed"], r["missing"]) for r in benchmark.check_answers(spark.createDataFrame([("a", "it is BLUE")], "id string, answer string"), checks).collect()}
    assert got == {"a": (True, []), "b": (False, ["x"])}
    with pytest.raises(ValueError):
        benchmark.canaries(spark, [{"id": "a"}])


def test_backfill(spark, tmp_path):
    from siltstone.sources import benchmark

    (tmp_path / "s1.jsonl").write_text(json.dumps({"role": "user", "content": "hi"}))
    assert benchmark.backfill(spark, str(tmp_path), ["s1"]).count() == 1 == benchmark.backfill(spark, str(tmp_path)).count()
    with pytest.raises(FileNotFoundError):
        benchmark.backfill(spark, str(tmp_path), ["s1", "lost"])
