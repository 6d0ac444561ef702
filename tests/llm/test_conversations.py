import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F
from siltstone.llm import conversations as C

ID = "0f0e0d0c-1111-4222-8333-{:012x}"
SCHEMA = "turn_id bigint, session_id string, source_file string, line_no int, ts string, role string, text string, sid string, seg int, turns string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def known(spark, ids):
    return spark.createDataFrame([(i, "x") for i in ids], "session_id string, sid string")


def order(spark, rows, ids, segment=C.SEGMENT):
    out = {}
    for r in C.rebuild(table(spark, rows), known(spark, ids), segment).collect():
        out.setdefault(r["session_id"], []).append((r["turn_pos"], r["turn_id"]))
    return {k: [t for _, t in sorted(v)] for k, v in out.items()}


def talk(n, sid, first=1, file="f", at=100, start=1):
    """n lines of user and assistant in turn."""
    return [(first + i, sid, file, start + i, str(1_700_000_000 + at + i), "user" if i % 2 == 0 else "assistant", f"t{first + i}") for i in range(n)]


def test_order_over_files_and_spellings(spark):
    s = ID.format(1)
    rows = talk(4, s, 1, "late", 900) + talk(4, "{" + s.upper() + "}", 11, "early", 100) + talk(2, f"urn:uuid:{s}", 21, "none")
    rows[-2:] = [(t, i, f, n, None, r, x) for t, i, f, n, _, r, x in rows[-2:]]
    rows += [(1000 + t, i, f, n, None, r, x) for t, i, f, n, _, r, x in rows[:4]]  # repeated rows, later ids
    random.Random(0).shuffle(rows)
    assert order(spark, rows, [f" {s}.jsonl"]) == {s: [11, 12, 13, 14, 1, 2, 3, 4, 21, 22]}


@pytest.mark.parametrize("segment", [2, 3, 2048])
def test_segments_do_not_change_the_order(spark, segment):
    s, t = ID.format(1), ID.format(2)
    rows = talk(11, s)[:10] + talk(6, s, 50, "g", 900) + talk(7, t, 80)[:7]
    assert order(spark, rows, [s, t], segment) == {s: list(range(1, 11)) + list(range(50, 56))}  # t ends with a user's turn


BROKEN = {
    "unknown session": lambda s: talk(2, s),
    "gap": lambda s: [r for r in talk(6, s) if r[3] not in (3, 4)],
    "starts late": lambda s: talk(2, s, start=2),
    "null line": lambda s: talk(2, s) + [(9, s, "f", None, None, "tool", "x")],
    "two texts": lambda s: talk(2, s) + [(9, s, "f", 2, None, "assistant", "other")],
    "no speaker": lambda s: talk(2, s) + [(9, s, "f", 3, None, "???", "x")],
    "null speaker": lambda s: talk(2, s) + [(9, s, "f", 3, None, None, "x")],
    "no turns": lambda s: [(1, s, "f", 1, None, "tool", "x"), (2, s, "f", 2, None, "user", " ​\xa0")],
    "assistant first": lambda s: [(1, s, "f", 1, None, "assistant", "a"), *talk(2, s, 2, start=2)],
    "no reply": lambda s: talk(3, s),
    "notice": lambda s: [*talk(3, s), (9, s, "f", 4, None, "assistant", "[cancelled]")],
    "reply in a second file is broken": lambda s: talk(2, s) + talk(1, s, 30, "g", 900),
}


BROKEN["long notice"] = lambda s: [*talk(3, s), (9, s, "f", 4, None, "assistant", "[request cancelled " + "by the client " * 300 + "]")]
BROKEN["long error"] = lambda s: [*talk(3, s), (9, s, "f", 4, None, "assistant", "API Error: 529 " + "overloaded, " * 300)]


def test_topological_order_and_leftovers():
    # 0 -> 1 -> 3, 2 -> 3; ties by the key
    assert C.topological([0, 1, 0, 2], [[1], [3], [3], []], [5, 1, 2, 0]) == [2, 0, 1, 3]
    # 1 and 2 wait for each other, 3 waits for them
    assert C.topological([0, 2, 2, 1], [[1, 2], [2, 3], [1], []], [0, 0, 0, 0]) == [0]
    indegree, followers, owner = C.line_graph([1, 2, 3, 5], [1, 2, 1, 1], 1)
    left = set(range(5)) - set(C.topological(indegree, followers, owner))
    assert left == {1, 2, 3, 4} and [owner[x] for x in sorted(left)] == [1, 1, 2, 3]  # two texts of line 2, what follows, the gap


@pytest.mark.parametrize("why", BROKEN)
def test_broken_sessions_are_left_out(spark, why):
    s, good = ID.format(5), ID.format(6)
    rows = BROKEN[why](s) + talk(2, good, 500)
    ids = [good] if why == "unknown session" else [s, good]
    for segment in (1, 2, C.SEGMENT):
        assert order(spark, rows, ids, segment) == {good: [500, 501]}


def test_blank_lines_and_tools_keep_their_place(spark):
    s = ID.format(7)
    rows = [(1, s, "f", 1, None, "system", "you are"), (2, s, "f", 2, None, " Human ", "q"), (3, s, "f", 3, None, "???", ""), (4, s, "f", 4, None, "tool_use", "x"), (5, s, "f", 5, None, "BOT", "a"), (6, s, None, 1, None, "user", "q2"), (7, s, None, 2, None, "ai", "a2")]
    assert order(spark, rows, [s]) == {s: [6, 7, 2, 5]}  # without times, files go by name


def test_rows_without_a_session(spark):
    rows = [(1, None, "f", 1, None, "user", "x"), (2, "", "f", 1, None, "user", "x"), (3, "unknown", "f", 1, None, "user", "x")]
    assert order(spark, rows, ["unknown", "", None]) == {}
    assert C.rebuild(table(spark, []), known(spark, [])).collect() == []


@pytest.mark.parametrize("text", ["(reply was empty)", "[reply stopped by the user]", "<answer lost: connection dropped>", "Error: stream ended before the first word", "Nothing to answer here.", "gave up waiting after 600 s", "Upstream error 529: server busy, try again", "[cancelled]"])
def test_notices(spark, text):
    assert spark.range(1).select(C.is_notice(F.lit(text)).alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["ok", "The error is in line 3: fix it.", "(see above)", "I cancelled the job. Next?", "Nothing else changed, all tests pass.", "- [x] done"])
def test_replies_are_no_notices(spark, text):
    assert not spark.range(1).select(C.is_notice(F.lit(text)).alias("x")).first()["x"]


def test_conversations_come_in_parts(spark):
    s = ID.format(8)
    parts = C.conversations(table(spark, talk(10, s)), known(spark, [s]), part_turns=4).orderBy("part_no").collect()
    assert [p["n_turns"] for p in parts] == [4, 4, 2] and [t["pos"] for p in parts for t in p["turns"]] == list(range(1, 11))


def test_against_brute_force(spark, small):
    """The whole small table against plain Python."""
    turns, sessions = spark.read.parquet(f"{small}/session_turns.parquet"), spark.read.parquet(f"{small}/agent_sessions.parquet")
    uuid = re.compile("[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")
    bare = lambda x: (m := uuid.search((x or "").lower())) and m.group()
    users, bots = {"user", "human", "you"}, {"assistant", "agent", "ai", "bot", "model"}
    others = {"tool", "tool_result", "tool_use", "function", "system", "developer"}
    notice = re.compile(r"[\[(<].*[\])>]|Error: .*|Upstream error .*|gave up .*|Nothing to answer here\.")

    def second(ts):
        if ts is None:
            return None
        if ts.isdigit():
            return int(ts) / (1 if len(ts) < 12 else 1000)
        return dt.datetime.fromisoformat(ts).timestamp()

    groups, ids = {}, {bare(r["session_id"]) for r in sessions.collect()}
    for r in turns.collect():
        if bare(r["session_id"]) in ids - {None}:
            groups.setdefault(bare(r["session_id"]), []).append(r)
    want = set()
    for sid, rows in groups.items():
        first, lines, bad = {}, {}, False
        for r in rows:
            role, seen = (r["role"] or "").strip().lower(), re.sub(r"[\s​]", "", r["text"] or "") != ""
            bad |= seen and role not in users | bots | others
            if (s := second(r["ts"])) is not None:
                first[r["source_file"]] = min(s, first.get(r["source_file"], s))
            kind = "" if not seen else "u" if role in users else "n" if role in bots and notice.fullmatch(r["text"].strip()) else "a" if role in bots else ""
            spot = lines.setdefault(r["source_file"], {}).setdefault(r["line_no"], {})
            spot[r["text"]] = min((r["turn_id"], kind), spot.get(r["text"], (1 << 60, "")))
        bad |= any(sorted(v) != list(range(1, len(v) + 1)) or any(len(x) > 1 for x in v.values()) for v in lines.values())
        seq = [x for f in sorted(lines, key=lambda f: (first.get(f, 9e18), f)) for n in sorted(lines[f], key=lambda n: n or 0) for x in lines[f][n].values() if x[1]]
        kinds = [k for _, k in seq]
        if bad or not seq or kinds[0] != "u" or any(k == "u" and kinds[i + 1 : i + 2] != ["a"] for i, k in enumerate(kinds)):
            continue
        want |= {(sid, i + 1, t) for i, (t, _) in enumerate(seq)}
    got = {tuple(r) for r in C.rebuild(turns, sessions).collect()}
    assert got == want and want
