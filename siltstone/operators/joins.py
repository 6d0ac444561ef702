"""Joins that Spark has no single operator for: overlapping intervals, as-of, text with a dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, by: str, width: int) -> DataFrame:
    """Rows of both sides whose closed intervals overlap within one key.

    Both sides have ``by``, ``start``, ``end``; other columns are kept, the right's
    ``start`` and ``end`` come out as ``r_start`` and ``r_end``.  Intervals are spread over
    buckets of ``width`` and equi-joined; a pair is emitted only in the bucket where the
    later interval starts, so no pair comes twice and nothing has to be de-duplicated.
    Long intervals in one key are spread over many buckets, so no key is one group.
    Null bounds and ends before starts overlap nothing.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("bigint")
    spread = lambda d, s, e: d.where(F.col(s) <= F.col(e)).withColumn("_bucket", F.explode(F.sequence(bucket(s), bucket(e))))
    r = right.withColumnRenamed("start", "r_start").withColumnRenamed("end", "r_end")
    joined = spread(left, "start", "end").join(spread(r, "r_start", "r_end"), [by, "_bucket"])
    here = (F.col("start") <= F.col("r_end")) & (F.col("r_start") <= F.col("end"))
    return joined.where(here & (F.col("_bucket") == F.floor(F.greatest("start", "r_start") / width))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, tolerance: int, value: str) -> DataFrame:
    """``left`` with the ``value`` and time (``right_time``) of the last right row at or before it, within ``tolerance``.

    ``time`` is a bigint on both sides; ``value`` must not be a column of ``left``.  Work is
    cut into time buckets as wide as the tolerance, so the match lies in the row's bucket
    or is the last one of the bucket before; a hot key is as many groups as it has buckets.
    Ties at one time take the greatest value.  Null keys and times match nothing.
    """
    bucket = F.floor(F.col(time) / tolerance).cast("bigint")
    r = right.select(by, F.col(time).alias("right_time"), value, bucket.alias("_bucket"))
    seen = F.struct("right_time", value)
    carried = r.groupBy(by, "_bucket").agg(F.max(seen).alias("_carried")).withColumn("_bucket", F.col("_bucket") + 1)
    l = left.withColumn("_bucket", bucket)  # noqa: E741
    both = l.withColumn("_side", F.lit(1)).unionByName(r.withColumn("_side", F.lit(0)).withColumn(time, F.col("right_time")), allowMissingColumns=True)
    w = Window.partitionBy(by, "_bucket").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_near", F.max(F.when(F.col("_side") == 0, seen)).over(w)).where("_side = 1").drop("right_time", value)
    hit = near.join(carried, [by, "_bucket"], "left").withColumn("_hit", F.coalesce("_near", "_carried"))
    ok = F.col(time) - F.col("_hit.right_time") <= tolerance
    return hit.withColumn("right_time", F.when(ok, F.col("_hit.right_time"))).withColumn(value, F.when(ok, F.col(f"_hit.{value}"))).drop("_bucket", "_side", "_near", "_carried", "_hit")


def mentions(texts: DataFrame, key: str, text: str, names: DataFrame) -> DataFrame:
    """(key, name, position): whole-word, case-insensitive places of dictionary names in texts, first one each.

    ``names`` has a column ``name``.  Names are met through their first word, an equi-join,
    and only then looked for, so no text meets every name.  Names under four characters,
    null names and texts give nothing.
    """
    split = r"(?U)\W+"
    n = names.select(F.lower("name").alias("name")).where(F.length("name") >= 4).distinct().withColumn("word", F.split("name", split)[0])
    words = texts.select(key, F.explode(F.array_distinct(F.split(F.lower(F.col(text)), split))).alias("word"))
    met = words.join(n, "word").groupBy(key).agg(F.collect_set("name").alias("_names"))  # the texts stay out of this shuffle
    pattern = F.concat(F.lit(r"(?U)\b"), F.regexp_replace("name", r"([.^$*+?()\[\]{}|\\-])", r"\\$1"), F.lit(r"\b"))
    near = texts.select(key, F.lower(F.col(text)).alias("_low")).join(met, key).select(key, "_low", F.explode("_names").alias("name"))
    return near.where(F.regexp_like("_low", pattern)).select(key, "name", F.regexp_instr(F.col("_low"), pattern).cast("bigint").alias("position"))
