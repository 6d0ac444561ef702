"""Questions about a code base, over the tables that ``sources.code`` and ``sources.files`` read.

facts: path, kind, a, b, c, d, first_line, last_line, confidence (see ``php_facts``);
routes: path, methods (array), action, file, template.  All answers are joins; the only
loops are the bounded walks of ``operators.graph``.  Unknown routes, files and symbols
give an error or no row, never a failure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import scoring as S
from siltstone.operators import graph, joins
from siltstone.session import broadcast_if_small, materialize

#: Commits that no decision is looked for in, and the kinds of decisions in order; the first that matches counts.
AUTOMATED = r"(?i)^(?:Merge|Bump|chore|ci|style|build|release)\b"
DECISIONS = (
    ("extraction", r"(?i)\bextract"), ("migration", r"(?i)\bmigrat"), ("replacement", r"(?i)\breplac"), ("removal", r"(?i)\b(?:remov|deprecat|delet)"),
    ("refactor", r"(?i)\brefactor|\brewrit|\brestructur"), ("introduction", r"(?i)\bintroduc|\badd\b.*\b(?:module|service|system)"),
)
#: Fixed value: methods that only give or set what an entity holds.
ACCESSOR = r"^(?:get|set|is|has|add|remove)[A-Z0-9_]"


def routes(facts: DataFrame) -> DataFrame:
    """(path, methods, action, file, template): of one path the last declaration in order of file and action counts."""
    r = facts.where("kind = 'route'").select(F.col("a").alias("path"), F.split("c", ",").alias("methods"), F.col("b").alias("action"), F.col("path").alias("file"), F.col("d").alias("template"))
    return r.groupBy("path").agg(F.max(F.struct("file", "action", "methods", "template")).alias("r")).select("path", "r.methods", "r.action", "r.file", "r.template")


def _edges(facts: DataFrame) -> DataFrame:
    """As ``calls``, but an edge may come repeatedly: the walks drop repeated ones themselves."""
    e = facts.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("c").alias("kind"))
    call = e.where("kind = 'call'").select("src", F.substring_index("dst", "::", 1).alias("cls"), F.substring_index("dst", "::", -1).alias("method"))
    methods = facts.where("kind = 'symbol'").select(F.substring_index("a", "::", 1).alias("cls"), F.substring_index("a", "::", -1).alias("method"))
    parents = facts.where("kind = 'class' and b is not null").select(F.col("a").alias("cls"), F.col("b").alias("parent"))
    found = graph.resolve_inherited(call, methods, parents)
    return found.select("src", F.concat("target", F.lit("::"), "method").alias("dst"), F.lit("call").alias("kind")).unionByName(e.where("kind <> 'call'"))


def calls(facts: DataFrame) -> DataFrame:
    """(src, dst, kind) of all edges; calls go to the nearest ancestor class that has the method."""
    return _edges(facts).distinct()


def is_accessor(symbol: Column) -> Column:
    """Whether a symbol only gives or sets what an entity holds."""
    return F.contains(F.substring_index(symbol, "::", 1), F.lit("\\Entity\\")) & F.substring_index(symbol, "::", -1).rlike(ACCESSOR)


def trace_routes(asked: DataFrame, all_routes: DataFrame, facts: DataFrame, max_depth: int = 6) -> DataFrame:
    """(method, path, error, trail, leaf, n): the call trees of routes, one row per path to a leaf.

    ``asked``: method, path.  Leaves that only read or set an entity are collapsed per caller
    into one row (leaf 'accessors', ``n`` of them).  A leaf that is no known symbol and no
    template is 'missing'.  An unknown route or method gives a row with an error.
    """
    q = asked.select(F.upper("method").alias("method"), "path").distinct().join(all_routes, "path", "left")
    error = F.when(F.col("action").isNull(), "no such route").when((F.size("methods") > 0) & ~F.array_contains("methods", F.col("method")), F.concat(F.lit("handles "), F.array_join("methods", ", ")))
    q = q.select("method", "path", F.when(error.isNull(), F.col("action")).alias("root"), error.alias("error"))
    walked = graph.trace(_edges(facts).select("src", "dst"), q.where("root is not null").select("root").distinct(), max_depth)
    last = F.element_at("path", -1)
    known = facts.where("kind = 'symbol'").select(F.col("a").alias("last")).distinct().withColumn("known", F.lit(True))
    leaves = walked.select("root", F.col("path").alias("trail"), last.alias("last"), "leaf").join(known, "last", "left")
    leaf = F.when((F.col("leaf") == "end") & F.col("known").isNull() & ~F.col("last").startswith("template:"), "missing").otherwise(F.col("leaf"))
    small = (F.col("leaf") == "end") & is_accessor(F.col("last")) & (F.size("trail") > 1)
    caller = F.array_join(F.slice("trail", 1, F.greatest(F.size("trail") - 1, F.lit(1))), " > ")
    rows = leaves.select("root", F.when(small, caller).otherwise(F.array_join("trail", " > ")).alias("trail"), F.when(small, "accessors").otherwise(leaf).alias("leaf"))
    rows = rows.groupBy("root", "trail", "leaf").agg(F.count("*").alias("n"))
    return q.join(rows, "root", "left").select("method", "path", "error", "trail", "leaf", "n")


def impact(hunks: DataFrame, facts: DataFrame, all_routes: DataFrame, hotspots: DataFrame, fetches: DataFrame | None = None, max_depth: int = 6) -> DataFrame:
    """(kind, name, reaches, least_depth, risk): routes and scripts from which changed methods are reached.

    ``hunks``: file, start, end; ``hotspots``: file, score; ``fetches``: src, action (of
    scripts).  A route's risk is the sum over the changed methods it reaches of the
    method's file's hotspot score (1 without one) over the depth, rounded to 2 digits.
    """
    spans = facts.where("kind = 'symbol'").select(F.col("path").alias("file"), F.col("a").alias("symbol"), F.col("first_line").cast("bigint").alias("start"), F.col("last_line").cast("bigint").alias("end"))
    changed = joins.overlap_join(spans, hunks.select("file", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end")), "file", 64).select("file", "symbol").distinct()
    changed = materialize(changed)
    edges = _edges(facts).where("kind = 'call'").select("src", "dst")
    if fetches is not None:
        edges = edges.unionByName(fetches.where("action is not null").select("src", F.col("action").alias("dst")))
    callers = graph.reach(edges, changed.select(F.col("symbol").alias("seed")), max_depth, reverse=True)
    reached = callers.join(changed.withColumnRenamed("symbol", "seed").hint("merge"), "seed").select("file", "node", "depth")
    risk = F.coalesce("score", F.lit(1.0)) / F.greatest("depth", F.lit(1))
    # few files have changed, so the history of others is dropped where it is read; scripts have no risk and need none of it
    hotspots = hotspots.select("file", "score").join(broadcast_if_small(changed.select("file").distinct()), "file", "left_semi")
    hit = reached.join(all_routes.select(F.col("action").alias("node"), F.col("path").alias("name")).hint("merge"), "node")
    hit = hit.join(hotspots.hint("merge"), "file", "left").select(F.lit("route").alias("kind"), "name", "depth", risk.alias("risk"))
    js = reached.where(F.col("node").startswith("js:")).select(F.lit("script").alias("kind"), F.col("node").alias("name"), "depth", F.lit(None).cast("double").alias("risk"))
    both = hit.unionByName(js).groupBy("kind", "name")
    return both.agg(F.count("*").alias("reaches"), F.min("depth").cast("bigint").alias("least_depth"), F.round(F.sum("risk"), 2).alias("risk"))


def rendered_by(templates: DataFrame, all_routes: DataFrame) -> DataFrame:
    """(template, route, action): the routes that render each template; ``templates/`` in front of its path does not count."""
    t = templates.select(F.col("path").alias("template"), F.regexp_replace("path", "^templates/", "").alias("name"))
    return t.join(all_routes.select(F.col("path").alias("route"), "action", F.col("template").alias("name")), "name").select("template", "route", "action")


def file_deps(nodes: DataFrame, edges: DataFrame, all_routes: DataFrame, hotspots: DataFrame, rationale: DataFrame) -> DataFrame:
    """One row per PHP file: kind, imports, files that import it and that it imports, routes, hotspot score and rationale.

    ``nodes``, ``edges``: as ``php_nodes`` and ``php_edges`` give them; ``hotspots``: file,
    score; ``rationale``: path.  Counts of what is not there are 0, a missing score null.
    """
    count = lambda df, key, name: df.groupBy(F.col(key).alias("path")).agg(F.count("*").alias(name))
    out = nodes.select("path", "type", F.size("imports").cast("bigint").alias("imports"))
    for df, key, name in ((edges, "dst", "in_degree"), (edges, "src", "out_degree"), (all_routes, "file", "routes"), (rationale, "path", "reasons")):
        out = out.join(count(df, key, name), "path", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.join(hotspots.select(F.col("file").alias("path"), "score"), "path", "left")


def hotspots(commits: DataFrame, today: str) -> DataFrame:
    """(file, score, commits, authors) of (sha, author, date, file): the decayed weight of a file's commits, 4 digits."""
    age = F.datediff(F.lit(today).cast("date"), F.col("date").cast("date"))
    return commits.groupBy("file").agg(F.round(F.sum(S.change_weight(age)), 4).alias("score"), F.count("*").alias("commits"), F.countDistinct("author").alias("authors"))


def decisions(commits: DataFrame, cap: int = 20) -> DataFrame:
    """(sha, date, kind, message, files) of the commits whose message tells a decision; automated ones are skipped.

    ``commits``: sha, date, message, file, one row per file.  ``files`` holds the first
    ``cap`` names, as the operator has it.
    """
    kind = None
    for name, pattern in DECISIONS:
        here = F.col("message").rlike(pattern)
        kind = F.when(here, name) if kind is None else kind.when(here, name)
    told = commits.where(~F.col("message").rlike(AUTOMATED)).withColumn("kind", kind).where("kind is not null")
    w = Window.partitionBy("sha").orderBy("file")
    named = told.select("sha", "date", "kind", "message", "file").distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    return named.groupBy("sha", "date", "kind", "message").agg(F.array_sort(F.collect_list("file")).alias("files"))
