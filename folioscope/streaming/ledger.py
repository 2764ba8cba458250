"""Observation streams: a first-seen ledger, and runs of failures in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def write_first_seen(stream: DataFrame, keys: list[str], at: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep a ledger of when each key was first seen, from what is available now.

    Every micro-batch writes its own folder, named by its number, so a batch that is
    run again after a failure replaces what it wrote. It writes keys the ledger
    lacks, and those that a late row shows to be older than known.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(*keys).agg(F.min(at).alias("first_seen"))
        known = read_first_seen(spark, path, keys, below=number)
        if known is not None:
            older = known.withColumnRenamed("first_seen", "known")
            fresh = fresh.join(older, keys, "left").where("known IS NULL OR first_seen < known").drop("known")
        fresh.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/number={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_first_seen(spark: SparkSession, path: str, keys: list[str], below: int | None = None) -> DataFrame | None:
    """The ledger: one row per key. With ``below``, as it was before that batch; null where there was none."""
    if below == 0:
        return None
    rows = spark.read.parquet(path)
    if below is not None:
        rows = rows.where(F.col("number") < below)
    return rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"))


def failure_runs(stream: DataFrame, key: str, order: list[str], failed: str) -> DataFrame:
    """Each failure of the stream with how many in a row it ends; a success clears the run.

    The state of a key is the length of its open run. Rows of a micro-batch are
    taken in ``order``; rows that come in later micro-batches count as later.
    """
    fields = [stream.schema[c] for c in (key, *order)]
    schema = T.StructType([*fields, T.StructField("run_length", T.LongType())])

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        rows = pd.concat(frames).sort_values(order, kind="stable")
        lengths = []
        for is_failure in rows[failed]:
            run = run + 1 if is_failure else 0
            lengths.append(run)
        state.update((run,))
        yield rows.assign(run_length=lengths)[rows[failed].astype(bool)][[f.name for f in schema.fields]]

    return stream.groupBy(key).applyInPandasWithState(step, schema, "run long", "append", GroupStateTimeout.NoTimeout)
