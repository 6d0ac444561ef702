"""Incremental pipelines on Structured Streaming.

Event times are cast to timestamps with zone, since watermarks refuse others.  Every
pipeline takes a streaming (or batch) frame and gives one, so tests and batch queries
run the same plan; ``run_available`` drives one to its end into a folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.selection import prefix_budget
from siltstone.sources.sinks import replace_partitions


def debounce(changes: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Changes (ts, kind, path) coalesced per kind until it was quiet: (kind, first, last, n_changes, n_paths, paths).

    A change exactly at the gap still joins its session.
    """
    t = changes.withColumn("ts", F.col("ts").cast("timestamp"))
    if t.isStreaming:
        t = t.withWatermark("ts", late)
    g = t.groupBy(F.session_window("ts", quiet).alias("w"), "kind")
    return g.agg(F.count("*").alias("n_changes"), F.sort_array(F.collect_set("path")).alias("paths")).select("kind", F.col("w.start").alias("first"), (F.col("w.end") - F.expr(f"interval {quiet}")).alias("last"), "n_changes", F.size("paths").cast("bigint").alias("n_paths"), "paths")


def throttle(flushes: DataFrame, key: str, window: str = "60 seconds") -> DataFrame:
    """The first of each key's rows within the window of event time; later ones are dropped.

    A row that is dropped opens no window.  A stream keeps its state per key; a batch cuts
    each key's rows where the window from the last kept row ends, in order of time.
    """
    t = flushes.withColumn("ts", F.col("ts").cast("timestamp"))
    if t.isStreaming:
        return t.withWatermark("ts", window).dropDuplicatesWithinWatermark([key])
    spark = flushes.sparkSession
    width = spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {window})")).first()[0]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, until = None, 0  # rows stream by, clustered by key and in order of time
        for batch in batches:
            at = []
            for i, (k, us) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if us is not None and (k != held or us >= until):
                    at.append(i)
                    held, until = k, us + width
            yield batch.select(range(2, batch.num_columns)).take(pa.array(at, pa.int64()))

    rows = t.select(F.col(key).alias("_key"), F.unix_micros("ts").alias("_us"), "*").where("_key is not null").repartition("_key").sortWithinPartitions("_key", "_us")
    return rows.mapInArrow(keep, t.schema)


def fresh_turns(turns: DataFrame) -> DataFrame:
    """(session_id, ordinal, text) of turns at or after each session's cursor, which never moves back.

    Replayed turns below the cursor are dropped; the state of a session is one number.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor = state.get[0] if state.exists else 0
        top = cursor
        for batch in batches:
            keep = batch[batch.ordinal >= cursor].drop_duplicates("ordinal")
            if len(keep):
                top = max(top, int(keep.ordinal.max()) + 1)
                yield keep[["session_id", "ordinal", "text"]].sort_values("ordinal")
        state.update((top,))

    schema = "session_id string, ordinal bigint, text string"
    return turns.select("session_id", F.col("ordinal").cast("bigint").alias("ordinal"), "text").groupBy("session_id").applyInPandasWithState(step, schema, "cursor bigint", "append", GroupStateTimeout.NoTimeout)


def fresh_window(turns: DataFrame, cursors: DataFrame, budget: int) -> DataFrame:
    """The turns (session_id, ordinal, text) at or after each session's cursor, oldest first, until the budget of characters is used.

    ``cursors``: session_id, cursor; a session without one starts at 0.  Nothing is skipped:
    the next call goes on where this one stopped.
    """
    new = turns.join(cursors.select("session_id", "cursor"), "session_id", "left").where(F.col("ordinal") >= F.coalesce("cursor", F.lit(0))).drop("cursor")
    return prefix_budget(new.withColumn("_chars", F.length(F.coalesce("text", F.lit("")))), "session_id", "ordinal", "_chars", budget).drop("_chars")


def lease_queue(jobs: DataFrame, now_s: int, lease_s: int = 300, attempts: int = 5) -> DataFrame:
    """(job_id, state) of queued jobs, oldest first: corrupt, exhausted, leased or ready.

    Jobs: job_id, created_at, spawned_at (epoch seconds), attempts, context.
    """
    state = (
        F.when(F.col("context").isNull() | F.col("created_at").isNull(), "corrupt")
        .when(F.coalesce("attempts", F.lit(0)) >= attempts, "exhausted")
        .when(F.col("spawned_at") > now_s - lease_s, "leased")
        .otherwise("ready")
    )
    return jobs.select("job_id", state.alias("state"), "created_at").orderBy("created_at", "job_id").drop("created_at")


def replace_changed(by: str, path: str):  # noqa: ANN201
    """A ``foreachBatch`` function that replaces the partitions a batch holds; running it twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        replace_partitions(batch, path, by)

    return write


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now into parquet files and gives them back."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
