"""Conversations rebuilt from message rows.

Method: every session is a reply graph.  A node is one text of one line of a transcript
file; it hangs on the line before it, and the files of a session follow each other by
their earliest timestamp.  Kahn's algorithm orders the graph: a node is released once
its predecessors have been, ties are broken by timestamp.  A line whose predecessor
never came is never released, nor are two texts that claim the same line, as each would
have to precede the other: they are a cycle.  Such leftover nodes, and nothing else,
mark the session's order as broken.  Role alternation and completeness are checked on
the order that results.

Scale: the graph is ordered in two steps.  Lines are grouped into *segments* of
``SEGMENT`` lines of one file, keyed by (session, file, segment), so a session that
holds a third of all rows is spread over many groups, none larger than ``SEGMENT``
lines (of texts that claim one line two are kept, which is a cycle already).  Kahn's
algorithm runs inside each segment and then over the segments, of which only one small
row each goes on to the second step, which streams through sessions one at a time.
Copies of a row collapse in the map-side half of the first aggregation, and texts travel
as two 64-bit hashes only.

Defined results for odd input: rows without a usable session id belong to no
session; a null or non-positive line number breaks its session; a null file name is
a file of its own; null, blank and invisible texts are no turns but keep their place
in the line numbers; of repeated rows the smallest turn id stays; a file without any
timestamp comes last; ties go by file name; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Lines of one file that form a segment.
SEGMENT = 2048

#: Spellings of the speakers, apart from case and blank space around them.
USER_ROLES = ("user", "human", "you", "me", "customer", "prompt")
ASSISTANT_ROLES = ("assistant", "agent", "ai", "bot", "model", "chatbot")
OTHER_ROLES = ("tool", "tool_result", "tool_use", "tool_call", "function", "function_call", "system", "developer", "environment")

#: A client's own notices that stand where a reply is missing.
NOTICE_WORDS = (
    r"cancell?ed|interrupted|aborted|stopped|terminated|timed? ?out|connection (?:was )?(?:dropped|lost|reset|closed|refused)"
    r"|lost|empty|no (?:reply|response|answer|output|content)|not available|unavailable|failed|failure|missing|dropped|killed"
    r"|rate.?limit\w*|overloaded|server busy|gave up|try again"
)
NOTICES = (
    rf"(?i)^[\[(<{{*]+[^\n]*?\b(?:{NOTICE_WORDS})\b[^\n]*[\])>}}*]+\.?$",
    r"(?i)^(?:api |upstream |internal |server |network |fatal |client )*error(?: \d{3})?\s*[:(\-][^\n]*$",
    r"(?i)^gave up (?:waiting )?(?:after|on) [^\n]*$",
    r"(?i)^(?:the )?(?:request|reply|response|answer|stream|connection|session) (?:was |has been |is )?(?:cancell?ed|interrupted|aborted|stopped|lost|empty|dropped|timed out|closed|ended)\b[^\n]*$",
    r"(?i)^(?:nothing to answer(?: here)?|no (?:reply|response|answer|output)(?: (?:was )?(?:given|received|available|needed|requested|required))?)\.?$",
    r"(?i)^(?:timed out|timeout|cancell?ed|interrupted|aborted)(?: (?:after|by|while)[^\n]*)?\.?$",
)

_UUID = r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
_EDGE = r"[\s\p{Z}\p{Cf}]*"


def bare_session_id(value: Column) -> Column:
    """The 8-4-4-4-12 form in lower case out of braces, urn prefix, path, file suffix or blanks; else null."""
    found = F.regexp_extract(F.lower(value), rf"^{_EDGE}(?:\S*[/\\])?[{{(\[\"']?(?:urn:uuid:|uuid:)?({_UUID})[}})\]\"']?(?:\.jsonl?)?{_EDGE}$", 1)
    return F.nullif(found, F.lit(""))


def is_visible(text: Column) -> Column:
    """Whether a text holds more than blank space and invisible characters; null and empty texts do not."""
    return F.coalesce(text, F.lit("")).rlike(r"[^\s\p{Z}\p{Cc}\p{Cf}\x{2800}\x{3164}\x{115F}\x{1160}\x{FFA0}\x{034F}]")


def role_class(role: Column) -> Column:
    """'user', 'assistant', 'other', or null when the speaker is not recognisable."""
    name = F.regexp_replace(F.lower(F.coalesce(role, F.lit(""))), r"[\s\p{Z}\p{Cf}:]+", "")
    return F.when(name.isin(*USER_ROLES), "user").when(name.isin(*ASSISTANT_ROLES), "assistant").when(name.isin(*OTHER_ROLES), "other")


def is_notice(text: Column) -> Column:
    """Whether an assistant's text, of whatever length, is only a client's notice of failure, interruption or absence."""
    edge = r"[\s\p{Z}\p{Cf}]*"
    # one pattern, looked for once: the text is not copied for each of them
    any_ = "|".join(p.removeprefix("(?i)^").removesuffix("$") for p in NOTICES)
    return text.rlike(f"(?i)^{edge}(?:{any_}){edge}$")


def row_micros(ts: Column) -> Column:
    """Microseconds since 1970 of ISO times with zone and of bare epoch seconds; else null."""
    return F.coalesce(
        F.unix_micros(F.when(ts.rlike(r"^\s*\d{4}-"), F.regexp_replace(F.trim(ts), r"([+-]\d{2})(\d{2})$", "$1:$2")).try_cast("timestamp")),
        F.when(ts.rlike(r"^\s*\d{9,11}(\.\d+)?\s*$"), (F.trim(ts).try_cast("decimal(20,6)") * 1_000_000).cast("bigint")),
        F.when(ts.rlike(r"^\s*\d{12,14}\s*$"), F.trim(ts).try_cast("bigint") * 1000),
        F.when(ts.rlike(r"^\s*\d{15,17}\s*$"), F.trim(ts).try_cast("bigint")),
    )


def segments(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per (sid, file, seg): its lines in order and what the graph step has to know of it."""
    text, role = F.col("text"), role_class(F.col("role"))
    seen = is_visible(text)
    rows = turns.select(
        "turn_id",
        bare_session_id(F.col("session_id")).alias("sid"),
        F.coalesce(F.col("source_file"), F.lit("\0")).alias("file"),
        F.col("line_no").cast("bigint").alias("line"),
        row_micros(F.col("ts")).alias("us"),
        F.xxhash64(F.coalesce(text, F.lit("\0"))).alias("h1"),
        F.xxhash64(F.lit(7), F.coalesce(text, F.lit("\0"))).alias("h2"),
        # 0 no turn, 1 user, 2 assistant's real reply, 3 assistant's place holder
        F.when(~seen, 0).when(role == "user", 1).when((role == "assistant") & is_notice(text), 3).when(role == "assistant", 2).otherwise(0).alias("kind"),
        (seen & role.isNull()).alias("nameless"),
    ).where("sid is not null")
    distinct = rows.groupBy("sid", "file", "line", "h1", "h2").agg(
        F.min("us").alias("us"), F.min(F.struct("turn_id", "kind")).alias("first"), F.max("nameless").alias("nameless")
    )
    seg = F.coalesce(F.floor((F.col("line") - 1) / segment), F.lit(-1)).cast("bigint")
    lines = distinct.groupBy("sid", "file", seg.alias("seg"), "line").agg(
        F.min("us").alias("us"), F.min("first").alias("first"), F.max("nameless").alias("nameless"), F.count("*").alias("texts")
    )
    node = F.struct("line", F.col("first.turn_id").alias("turn_id"), F.col("first.kind").alias("kind"), F.least("texts", F.lit(2)).cast("int").alias("texts"))
    return lines.groupBy("sid", "file", "seg").agg(
        F.min("us").alias("us"),
        F.max("nameless").alias("nameless"),
        # at most `segment` lines: distinct line numbers of one segment
        F.array_sort(F.collect_list(node)).alias("lines"),
    )


def topological(indegree: list[int], followers: list[list[int]], tie: list) -> list[int]:
    """Kahn's algorithm: the nodes that can be ordered, least ``tie`` first among those released; the others are left over."""
    waiting = list(indegree)
    ready = [(tie[x], x) for x, n in enumerate(waiting) if n == 0]
    heapq.heapify(ready)
    order = []
    while ready:
        _, x = heapq.heappop(ready)
        order.append(x)
        for y in followers[x]:
            waiting[y] -= 1
            if waiting[y] == 0:
                heapq.heappush(ready, (tie[y], y))
    return order


def line_graph(lines: list[int | None], texts: list[int], first: int | None) -> tuple[list[int], list[list[int]], list[int]]:
    """(indegree, followers, line index) of the texts of one segment's lines, which ``first`` opens.

    Each text waits for all texts of the line before; texts of one line wait for each other.
    The first line waits for nothing here: the segment as a whole waits for the one before.
    """
    at = {n: k for k, n in enumerate(lines)}
    owner = [k for k, n in enumerate(texts) for _ in range(n)]
    nodes: list[list[int]] = [[] for _ in lines]
    for x, k in enumerate(owner):
        nodes[k].append(x)
    indegree, followers = [0] * len(owner), [[] for _ in owner]
    for x, k in enumerate(owner):
        before = at.get(lines[k] - 1) if lines[k] is not None else None
        if before is not None:
            for y in nodes[before]:
                followers[y].append(x)
                indegree[x] += 1
        elif first is None or lines[k] != first:
            indegree[x] += 1  # waits for a line that is not there
        for y in nodes[k]:
            if y != x:
                followers[y].append(x)
                indegree[x] += 1
    return indegree, followers, owner


_NODES = "sid string, file string, seg bigint, us bigint, bad boolean, whole boolean, n int, head int, tail int, inner boolean"


def _contract(segment: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Orders the lines of each segment; gives what the step over segments has to know of it.

    bad: a text is left over or its speaker is unknown; whole: it holds all lines that a
    segment can; n, head, tail, inner: its turns in the order found, the kinds of the first and last,
    and whether every user's turn but the last has its reply next.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, files, segs, us, nameless, lists = batch.columns
            flat, ends = lists.flatten(), np.cumsum(np.asarray(lists.value_lengths())).tolist()
            line, kind, texts = (flat.field(k).to_pylist() for k in (0, 2, 3))
            out, start = [], 0
            for end, seg, unknown in zip(ends, segs.to_pylist(), nameless.to_pylist(), strict=True):
                indegree, followers, owner = line_graph(line[start:end], texts[start:end], seg * segment + 1 if seg >= 0 else None)
                order = topological(indegree, followers, owner)
                turns = [k for x in order if (k := kind[start + owner[x]])]
                whole = len(owner) == segment and len(order) == len(owner)
                inner = all(a != 1 or b == 2 for a, b in pairwise(turns))
                out.append((bool(unknown) or len(order) < len(owner), whole, len(turns), turns[0] if turns else None, turns[-1] if turns else None, inner))
                start = end
            types = (pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            made = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([sids, files, segs, us, *made], names=["sid", "file", "seg", "us", "bad", "whole", "n", "head", "tail", "inner"])

    return scan


def _kahn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Orders the segments of each session; the input is clustered and sorted by session.

    Emits (sid, file, seg, offset) for the sessions that pass, offset being the number
    of turns before the segment.
    """

    def close(nodes: list[tuple]) -> list[tuple]:
        # nodes: (sid, file, seg, us, bad, whole, n, head, tail, inner)
        sid = nodes[0][0]
        if any(x[4] for x in nodes):
            return []
        first_us: dict[str, float] = {}
        for _, file, _, us, *_ in nodes:
            if us is not None:
                first_us[file] = min(us, first_us.get(file, us))
        at = {(x[1], x[2]): k for k, x in enumerate(nodes)}
        followers: list[list[int]] = [[] for _ in nodes]
        for (file, seg), k in at.items():
            if nodes[k][5] and (file, seg + 1) in at:  # only a whole segment releases the next one
                followers[k].append(at[file, seg + 1])
        order = topological([int(x[2] > 0) for x in nodes], followers, [(first_us.get(x[1], float("inf")), x[1], x[2]) for x in nodes])
        if len(order) < len(nodes):  # leftover nodes
            return []
        out, offset, before = [], 0, 0
        for _, file, seg, _, _, _, n, head, tail, inner in (nodes[k] for k in order):
            if n:
                if not inner or (offset == 0 and head != 1) or (before == 1 and head != 2):
                    return []
                before = tail
            out.append((sid, file, seg, offset))
            offset += n
        return out if offset and before != 1 else []

    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False, name=None):
            if held and held[0][0] != row[0]:
                out += close(held)
                held = []
            held.append(row)
        yield pd.DataFrame(out, columns=["sid", "file", "seg", "offset"])
    if held:
        yield pd.DataFrame(close(held), columns=["sid", "file", "seg", "offset"])


def rebuild(turns: DataFrame, sessions: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(session_id, turn_pos, turn_id) of every turn of the conversations that are whole.

    ``turns``: turn_id, session_id, source_file, line_no, ts, role, text; ``sessions``:
    session_id of the known sessions.  Further columns are ignored.  A conversation is
    dropped when its graph leaves nodes over, a visible text has no recognisable
    speaker, it does not start with a user's turn, or a user's turn is not followed by
    an assistant's real reply.
    """
    segs = materialize(segments(turns, segment))
    nodes = segs.mapInArrow(_contract(segment), _NODES)
    known = sessions.select(bare_session_id(F.col("session_id")).alias("sid")).where("sid is not null").distinct()
    nodes = nodes.join(known, "sid", "left_semi").repartition("sid").sortWithinPartitions("sid", "file", "seg")
    kept = nodes.mapInPandas(_kahn, "sid string, file string, seg bigint, offset bigint")
    placed = segs.select("sid", "file", "seg", F.filter("lines", lambda x: x["kind"] > 0).alias("turns")).join(kept, ["sid", "file", "seg"])
    return placed.select("sid", "offset", F.posexplode("turns").alias("k", "turn")).select(
        F.col("sid").alias("session_id"), (F.col("offset") + F.col("k") + 1).cast("int").alias("turn_pos"), F.col("turn.turn_id").alias("turn_id")
    )


def conversations(turns: DataFrame, sessions: DataFrame, part_turns: int = 500) -> DataFrame:
    """The rebuilt conversations with their texts, as ordered lists of (pos, role, text).

    Long conversations come in parts of ``part_turns`` turns, so no list grows without
    bound: (session_id, part_no, n_turns, turns).
    """
    order = rebuild(turns, sessions)
    texts = turns.select("turn_id", role_class(F.col("role")).alias("role"), "text")
    part = F.floor((F.col("turn_pos") - 1) / part_turns).cast("int")
    return (
        order.join(texts, "turn_id")
        .groupBy("session_id", part.alias("part_no"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("turn_pos").alias("pos"), "role", "text"))).alias("turns"))
        .select("session_id", "part_no", F.size("turns").alias("n_turns"), "turns")
    )
