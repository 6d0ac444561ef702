"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    return both.where("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    low = down.groupBy("src").agg(F.min("dst").alias("low"))
    moved = down.join(low, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst")
    return moved.unionByName(low.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge (src, dst); the component is its least node.

    Rounds needed grow with the logarithm of the longest path.  Each round is written to
    the shared checkpoint folder, so lineage stays short and lost executors cost one
    round; a graph that does not settle in ``max_rounds`` raises.  No adjacency list is ever gathered in one place: minima are partial
    aggregates.  Loops and nulls are ignored; a node without an edge does not come out.
    """
    now = materialize(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    seen = None
    for _ in range(max_rounds):
        now = materialize(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"the components did not settle in {max_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
