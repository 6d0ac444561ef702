"""Selection under a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_budget(items: DataFrame, key: str, score: str, size: str, budget: int, pinned: str | None = None, page: int = 10_000) -> DataFrame:
    """(key, place) of the items a greedy pass takes: pinned first, always; then by score, skipping what overflows.

    This is a sequential fold, so it runs over pages of the best ``page`` rows that still
    fit, each a bounded top-k; it stops when nothing left can fit.  At most ``budget`` items
    of positive size can be taken.  Null sizes count as 0, null scores come last, ties go
    by key.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("key"), F.coalesce(F.col(score), F.lit(float("-inf"))).cast("double").alias("score"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"), (F.col(pinned) if pinned else F.lit(False)).alias("pin"))
    head = rows.where("pin").select("key").orderBy("key")
    taken = [r["key"] for r in head.toLocalIterator()]
    used = rows.where("pin").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    rest, last = rows.where("not coalesce(pin, false)"), None
    while True:
        fit = rest.where(F.col("size") <= budget - used)
        if last is not None:
            fit = fit.where((F.col("score") < last[0]) | ((F.col("score") == last[0]) & (F.col("key") > F.lit(last[1]))))
        batch = fit.orderBy(F.desc("score"), "key").limit(page).collect()
        for r in batch:
            if used + r["size"] <= budget:
                taken.append(r["key"])
                used += r["size"]
        if len(batch) < page:
            break
        last = (batch[-1]["score"], batch[-1]["key"])
    kind = items.schema[key].dataType.simpleString()
    return spark.createDataFrame([(k, i + 1) for i, k in enumerate(taken)], f"{key} {kind}, place bigint")


def prefix_budget(rows: DataFrame, group: str, position: str, size: str, budget: int, separator: int = 1, block: int = 4096) -> DataFrame:
    """The rows of each group, in order, until the next would exceed the budget, with ``used`` so far.

    Positions are whole numbers, one row each, with or without gaps; rows without one are in no prefix.  What stands before
    a block of ``block`` positions is a running sum over blocks, so only blocks that the
    budget reaches are looked at row by row, each on its own, whatever the group holds.
    """
    if separator < 1:
        raise ValueError("the separator must cost at least 1")
    cost = F.coalesce(F.col(size), F.lit(0)) + separator
    here = rows.where(F.col(position).isNotNull()).withColumn("_block", F.floor(F.col(position) / block).cast("bigint"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = here.groupBy(group, "_block").agg(F.sum(cost).alias("_cost")).withColumn("_before", F.coalesce(F.sum("_cost").over(before), F.lit(0))).where(F.col("_before") < budget)
    w = Window.partitionBy(group, "_block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    near = here.join(blocks.drop("_cost"), [group, "_block"])
    return near.withColumn("used", F.col("_before") + F.sum(cost).over(w)).where(F.col("used") <= budget).drop("_block", "_before")
