"""Session helpers: building a local session, cutting lineage, reading the driver tables."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "siltstone", cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``; make one only for a local master.

    On a cluster the folder has to be shared by all executors, so a missing setting
    is an error there instead of a silent fall back to a machine-local folder.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held(df: DataFrame, by: str | None = None, values: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once to the checkpoint folder as compressed batches, of a size that the planner does not guess.

    For rows that are dear to make and read several times.  What a plan expects of rows made
    in Python may lie far below what comes; here it is told nothing, so a join broadcasts
    them only when a shuffle has measured that they are few.  With a string column ``by`` and
    all its ``values`` (others raise), batches hold one value each, and a filter for one
    value unpacks no others.
    """
    schema = df.schema

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(None, batch)]
            if by is not None:
                column = batch.column(batch.schema.get_field_index(by))
                if other := set(column.unique().to_pylist()) - set(values):
                    raise ValueError(f"unknown values of {by}: {other}")
                parts = [(v, batch.filter(pc.equal(column, v))) for v in values]
            for value, part in parts:
                if not part.num_rows and by is not None:
                    continue
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([value], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["value", "batch"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for packed in batches:
            for one in packed.column(0):
                yield from pa.ipc.open_stream(one.as_buffer())

    def unsized(packed: DataFrame) -> DataFrame:
        back = packed.select("batch").mapInArrow(unpack, schema)
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(back._jdf.queryExecution().toRdd(), back._jdf.schema(), False), spark)

    spark, kept = df.sparkSession, materialize(df.mapInArrow(pack, "value string, batch binary"))
    if by is None:
        return unsized(kept)
    each = [unsized(kept.where(F.col("value") == v)).withColumn(by, F.lit(v)) for v in values]
    return reduce(DataFrame.unionByName, each)


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` written down and counted; with a hint to broadcast it if it has at most ``rows`` rows, else without.

    A larger side is joined by a shuffle, with the same result.
    """
    held = materialize(df)
    return F.broadcast(held) if held.count() <= rows else held


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when its scan has too few pieces to use them, as with one small file.

    Larger inputs have enough splits and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if pieces < cores // 2 else df
