"""Graph traversal, cycles and communities over edge tables (src, dst).

Every loop works on a frontier that is joined with the edges, keeps the nodes seen so
far in the shared checkpoint folder and is bounded by a depth or by convergence;
adjacency lists are never gathered.  Null ends are ignored, repeated edges count once,
an unknown seed reaches nothing, an empty edge table gives empty results.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


def _clean(edges: DataFrame) -> DataFrame:
    return edges.where("src is not null and dst is not null").select("src", "dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    e = _clean(edges)
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int, reverse: bool = False) -> DataFrame:
    """(seed, node, depth): the least number of steps, 1..max_depth, from each seed.

    ``seeds`` has a column ``seed``.  A cycle can lead back to the seed itself, which then
    comes out with its depth.  ``reverse`` follows edges backwards: who reaches the seed.
    """
    e = materialize(_clean(edges).select(F.col("dst").alias("at"), F.col("src").alias("to")) if reverse else _clean(edges).toDF("at", "to"))
    frontier = seeds.select("seed", F.col("seed").alias("at")).distinct()
    found = None
    for depth in range(1, max_depth + 1):
        step = frontier.join(e, "at").select("seed", F.col("to").alias("node")).distinct()
        if found is not None:
            step = step.join(found.select("seed", "node"), ["seed", "node"], "left_anti")
        step = materialize(step.withColumn("depth", F.lit(depth)))
        if step.isEmpty():
            break
        found = step if found is None else found.unionByName(step)
        frontier = step.select("seed", F.col("node").alias("at"))
    return step if found is None else found


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth) within ``depth`` (kept in 1..3) steps, whatever the direction; seeds themselves left out."""
    return reach(undirected(edges), seeds, max(1, min(3, depth))).where("node <> seed")


def trace(edges: DataFrame, roots: DataFrame, max_depth: int = 6) -> DataFrame:
    """(root, path, leaf): every path of the call tree from the roots; ``leaf`` is 'cycle', 'depth' or 'end'.

    Paths are enumerated, not nodes, so start from few roots: their number can grow with
    the branching to the power of the depth.
    """
    e = materialize(_clean(edges).toDF("at", "to"))
    known = e.select("at").distinct().withColumn("calls", F.lit(True))
    level = roots.select(F.col("root"), F.array("root").alias("path"), F.col("root").alias("at"), F.lit(False).alias("cycle"))
    out = None
    for depth in range(max_depth + 1):
        level = materialize(level.join(known, "at", "left").select("root", "path", "at", "cycle", F.coalesce("calls", F.lit(False)).alias("calls")))
        ended = level.where(F.col("cycle") | ~F.col("calls") | F.lit(depth == max_depth))
        kind = F.when(F.col("cycle"), "cycle").when(~F.col("calls"), "end").otherwise("depth")
        ended = ended.select("root", "path", kind.alias("leaf"))
        out = ended if out is None else out.unionByName(ended)
        if depth == max_depth:
            break
        grown = level.where(F.col("calls") & ~F.col("cycle")).join(e, "at")
        level = grown.select("root", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("at"), F.array_contains("path", F.col("to")).alias("cycle"))
    return out


def shortest_path(edges: DataFrame, start: str, end: str, max_depth: int = 12) -> DataFrame:
    """(step, node) of one shortest undirected path; of equal ones the one with the least nodes, from the end back.

    Empty if there is none within ``max_depth`` (kept in 1..12).
    """
    spark = edges.sparkSession
    e = materialize(undirected(edges).toDF("at", "to"))
    seen = materialize(spark.createDataFrame([(start, None, 0)], "node string, parent string, depth int"))
    frontier = seen
    depth = 0
    while depth < max(1, min(12, max_depth)) and start != end:
        depth += 1
        step = frontier.select(F.col("node").alias("at")).join(e, "at").groupBy(F.col("to").alias("node")).agg(F.min("at").alias("parent"))
        step = materialize(step.join(seen, "node", "left_anti").select("node", "parent", F.lit(depth).alias("depth")))
        if step.isEmpty():
            break
        seen = seen.unionByName(step)
        if not step.where(F.col("node") == end).isEmpty():
            break
        frontier = step
    path, node = [], end
    for _ in range(depth + 1):  # at most the depth: one small lookup per step
        row = seen.where(F.col("node") == node).first()
        if row is None:
            break
        path.append(node)
        if row["parent"] is None:
            break
        node = row["parent"]
    path = path[::-1] if path and path[-1] == start else []
    return spark.createDataFrame([(i, n) for i, n in enumerate(path)], "step int, node string")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components of at least two nodes, and single nodes with a loop.

    Forward-backward colouring: colours (the greatest id that reaches a node) spread
    forward to a fixed point; what reaches a colour's root backwards inside its colour is
    one component.  Found components leave the graph and the rest goes round again, after
    nodes without an edge in or out have been trimmed.  Every round finds a component,
    so the rounds end by themselves.
    """
    all_edges = _clean(edges)
    loops = all_edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component"))
    e = materialize(all_edges.where("src <> dst"))
    done = None
    while True:
        size = e.count()
        while size:  # trim
            e = materialize(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            left = e.count()
            if left == size:
                break
            size = left
        if not size:
            break
        colour = materialize(e.select(F.col("src").alias("node")).unionByName(e.select("dst").toDF("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            pushed = colour.join(e, colour["node"] == e["src"]).groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("pushed"))
            nxt = materialize(colour.join(pushed, "node", "left").select("node", F.greatest("colour", F.coalesce("pushed", "colour")).alias("colour"), (F.coalesce("pushed", "colour") > F.col("colour")).alias("moved")))
            colour = nxt.select("node", "colour")
            if nxt.where("moved").isEmpty():
                break
        inner = e.join(colour.toDF("src", "c1"), "src").join(colour.toDF("dst", "c2"), "dst").where("c1 = c2").select("src", "dst", "c1")
        inner = materialize(inner)
        member = materialize(colour.where("node = colour"))
        frontier = member
        while True:
            step = frontier.join(inner, (frontier["node"] == inner["dst"]) & (frontier["colour"] == inner["c1"])).select(inner["src"].alias("node"), "colour").distinct()
            step = materialize(step.join(member, ["node", "colour"], "left_anti"))
            if step.isEmpty():
                break
            member = member.unionByName(step)
            frontier = step
        member = materialize(member)
        done = member if done is None else done.unionByName(member)
        gone = member.select("node")
        e = materialize(e.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    if done is None:
        return loops
    sized = done.groupBy("colour").agg(F.count("*").alias("n"), F.min("node").alias("component")).where("n > 1")
    big = done.join(sized, "colour").select("node", "component")
    return big.unionByName(loops.join(big.select("node"), "node", "left_anti"))


def communities(edges: DataFrame, min_size: int = 2, rounds: int = 20) -> DataFrame:
    """(community_id, node, hub, size, label): communities by label propagation, deterministic.

    Every node takes the label that most of its neighbours and itself hold; ties go to
    the least label, so no seed is needed.  Labels of some graphs never settle; the state
    after ``rounds`` is given then, with a warning.  Loops are dropped; ids count from 0 by size,
    largest first, then hub; the hub has the most neighbours, then the least name.
    """
    e = materialize(undirected(edges).where("src <> dst"))
    label = materialize(e.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = e.join(label.toDF("dst", "label"), "dst").select(F.col("src").alias("node"), "label").unionByName(label)
        count = votes.groupBy("node", "label").agg(F.count("*").alias("n"))
        nxt = count.groupBy("node").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("b")).select("node", F.col("b.label").alias("label"))
        nxt = materialize(nxt)
        same = nxt.join(label, ["node", "label"], "left_anti").isEmpty()
        label = nxt
        if same:
            break
    else:
        warnings.warn(f"the labels did not settle in {rounds} rounds", stacklevel=2)
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    # the label of a community for readers: its three shortest names
    short = Window.partitionBy("label").orderBy(F.length("node"), "node")
    named = label.withColumn("n", F.row_number().over(short)).where("n <= 3").groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "node"))), lambda x: x["node"]), " / ").alias("name"))
    info = label.join(degree, "node").groupBy("label").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("h")).where(F.col("size") >= min_size)
    w = Window.orderBy(F.desc("size"), "hub")  # one row per community
    ids = info.select("label", "size", F.col("h.node").alias("hub")).withColumn("community_id", F.row_number().over(w) - 1).join(named, "label")
    return label.join(ids, "label").select("community_id", "node", "hub", "size", F.col("name").alias("label"))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """One row: the modularity of (node, community_id) over the undirected edges."""
    e = undirected(edges).where("src <> dst")
    m = member.select("node", "community_id")
    both = e.join(m.toDF("src", "c1"), "src", "left").join(m.toDF("dst", "c2"), "dst", "left")
    total = both.agg(F.count("*").alias("two_m"), F.count_if(F.col("c1") == F.col("c2")).alias("inside"))
    degree = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("d")).join(m, "node").groupBy("community_id").agg(F.sum("d").alias("d"))
    square = degree.agg(F.sum(F.col("d") * F.col("d")).alias("sq"))
    return total.join(F.broadcast(square)).select(F.round(F.col("inside") / F.col("two_m") - F.col("sq") / (F.col("two_m") * F.col("two_m")), 6).alias("modularity"))  # one row


def resolve_inherited(calls: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """``calls`` (src, cls, method) with ``target``: the nearest ancestor class that has the method.

    A class of its own keeps the call, cycles of inheritance end, what nobody has stays as
    it was written.
    """
    have = methods.select(F.col("cls").alias("up"), "method").distinct()
    # most calls name the class that has the method; only the others climb, each pair of class and method once
    wanted = calls.select("cls", "method").distinct()
    open_ = materialize(wanted.join(have.withColumnRenamed("up", "cls"), ["cls", "method"], "left_anti").withColumn("up", F.col("cls")))
    tried, out = open_, None
    while not open_.isEmpty():
        up = open_.join(parents.select(F.col("cls").alias("up"), "parent"), "up").select("cls", "method", F.col("parent").alias("up")).distinct()
        met = materialize(up.join(tried, ["cls", "method", "up"], "left_anti").join(have.withColumn("has", F.lit(True)), ["up", "method"], "left").select("cls", "method", "up", "has"))
        hit = met.where("has").select("cls", "method", F.col("up").alias("target"))
        out = hit if out is None else out.unionByName(hit)
        open_ = met.where("has is null").drop("has")
        tried = tried.unionByName(met.drop("has"))
    each = calls.select("src", "cls", "method").distinct()
    if out is None:
        return each.withColumn("target", F.col("cls"))
    return each.join(out, ["cls", "method"], "left").select("src", "cls", "method", F.coalesce("target", "cls").alias("target"))
