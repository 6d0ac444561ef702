"""Retrieval metrics over ranked hits and gold pairs, all questions in one job.

Questions without gold are left out, as they have no defined recall; a question with
gold and no hits scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_question(ranked: DataFrame, gold: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """(query, recall_any, rr, ndcg): whether any gold is in the first k, 1 / its first rank, binary NDCG@k."""
    sizes = gold.distinct().groupBy(query).agg(F.count("*").alias("n_gold"))
    hits = ranked.where(F.col("rank") <= k).join(gold.distinct(), [query, key]).groupBy(query).agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return sizes.join(hits, query, "left").select(
        query, F.when(F.col("first").isNotNull(), 1.0).otherwise(0.0).alias("recall_any"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        F.round(F.coalesce(F.col("dcg"), F.lit(0.0)) / ideal, 6).alias("ndcg"),
    )


def summary(scores: DataFrame, group: str) -> DataFrame:
    """Means per group and over all (the group null), by one ROLLUP."""
    return scores.rollup(group).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 6).alias(m) for m in ("recall_any", "rr", "ndcg")])
