"""One entry for all kinds of search, with checked arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators import ranking

MODES = ("lexical", "vector", "hybrid")


def search(corpus: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int = 5, mode: str = "hybrid", keep: DataFrame | None = None, oversample: int = 3) -> DataFrame:
    """(query, key, score, rank) in one of ``MODES``; ``keep`` (a column ``key``) filters hits after the statistics, before the limit.

    An unknown mode and a limit below 1 raise.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known are {MODES}")
    if k < 1:
        raise ValueError("the limit must be at least 1")
    kept = (lambda df: df) if keep is None else (lambda df: df.join(keep.select(key).distinct(), key, "left_semi"))
    pool = k if mode != "hybrid" else k * oversample
    legs = []
    if mode != "lexical":
        legs.append(ranking.bag_cosine(kept(corpus), key, text, queries, query, query_text, pool))  # a vector filter comes first
    if mode != "vector":
        legs.append(ranking.top(kept(ranking.bm25(corpus, key, text, queries, query, query_text, None)), query, key, pool))
    if len(legs) == 1:
        return legs[0].select(query, key, "score", "rank")
    streams = legs[0].select(query, F.lit(1).alias("stream"), key, "rank").unionByName(legs[1].select(query, F.lit(2).alias("stream"), key, "rank"))
    return ranking.fuse(streams, query, key, k).select(query, key, F.col("rrf_score").alias("score"), F.col("place").alias("rank"))
