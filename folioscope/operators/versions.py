"""Versions in time: as-of reads, islands, intervals, revisions and holders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(versions: DataFrame, key: str, at: str, cutoff: str, *values: str) -> DataFrame:
    """The newest row of each key on or before the end of the day ``cutoff`` (UTC), by (at, values)."""
    before = versions.where(F.col(at) < F.date_add(F.to_date(F.lit(cutoff)), 1).cast("timestamp"))
    newest = F.max(F.struct(at, *values)).alias("newest")
    return before.groupBy(key).agg(newest).select(key, "newest.*")


def as_of_join(probes: DataFrame, states: DataFrame, key: str, probe_at: str, state_at: str, value: str) -> DataFrame:
    """Each probe with the value of the latest state at or before it.

    Both sides are put on one line in time and the last state is carried
    forward, so no probe meets more than its own row. A state at the same
    instant counts as before.
    """
    line = probes.select(key, F.col(probe_at).alias("__at"), F.lit(1).alias("__kind"), F.struct(*probes.columns).alias("__probe"), F.lit(None).cast(states.schema[value].dataType).alias("__value"), F.lit(None).cast("timestamp").alias("__since"))
    line = line.unionByName(
        states.select(key, F.col(state_at).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(line.schema["__probe"].dataType).alias("__probe"), F.col(value).alias("__value"), F.col(state_at).alias("__since"))
    )
    back = Window.partitionBy(key).orderBy("__at", "__kind", F.col("__value").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.select(
        "__probe", "__kind", F.last("__value", True).over(back).alias("state_value"), F.last("__since", True).over(back).alias("state_at")
    )
    return seen.where("__kind = 1").select("__probe.*", "state_value", "state_at")


def islands(sightings: DataFrame, key: str, order: list[str], content: Column, at: str) -> DataFrame:
    """Runs of equal content in order: version number, content, first and last sighting. A-B-A is three versions."""
    line = Window.partitionBy(key).orderBy(*order)
    held = sightings.withColumn("content", content)
    starts = F.coalesce(F.lag("content").over(line) != F.col("content"), F.lit(True)).cast("int")
    numbered = held.withColumn("__starts", starts).withColumn("version", F.sum("__starts").over(line))
    return numbered.groupBy(key, "version", "content").agg(
        F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("n_sightings")
    )


def located(versions: DataFrame, key: str, instant: str) -> DataFrame:
    """Where an instant falls for each key: within a version, between two, before the first or after the last."""
    at = F.to_timestamp(F.lit(instant))
    flags = versions.groupBy(key).agg(
        F.max(F.when((F.col("first_seen") <= at) & (F.col("last_seen") >= at), F.col("version"))).alias("inside"),
        F.max(F.when(F.col("last_seen") < at, F.col("version"))).alias("before"),
        F.min(F.when(F.col("first_seen") > at, F.col("version"))).alias("after"),
    )
    outcome = (
        F.when(F.col("inside").isNotNull(), "contained")
        .when(F.col("before").isNull(), "before_first_observation")
        .when(F.col("after").isNull(), "after_last_observation")
        .otherwise("between_observations")
    )
    return flags.select(key, outcome.alias("outcome"), "inside", "before", "after")


def revisions(records: DataFrame, key: str, order: list[str], substance: Column) -> DataFrame:
    """Append a revision only where the substance differs from the one before; numbered from 1."""
    line = Window.partitionBy(key).orderBy(*order)
    held = records.withColumn("substance", substance)
    fresh = held.withColumn("__before", F.lag("substance").over(line)).where("__before IS NULL OR __before <> substance")
    return fresh.withColumn("rev", F.row_number().over(line).cast("long")).drop("__before")


def appended(previous: DataFrame, fresh: DataFrame, key: str, substance: str) -> DataFrame:
    """The rows to append to a revision table: those that differ from their key's latest revision."""
    latest = previous.groupBy(key).agg(F.max(F.struct("rev", substance)).alias("l"))
    rows = fresh.join(latest, key, "left").where(F.col("l").isNull() | (F.col(f"l.{substance}") != F.col(substance)))
    return rows.withColumn("rev", F.coalesce(F.col("l.rev"), F.lit(0)) + 1).drop("l")


def revision_gaps(records: DataFrame, key: str) -> DataFrame:
    """Keys whose revisions are not 1..n."""
    per = records.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("rev").alias("top"), F.countDistinct("rev").alias("kinds"))
    return per.where("n <> top OR n <> kinds")


def holder_spans(revs: DataFrame, address: str, holder: str, at: str) -> DataFrame:
    return revs.groupBy(address, holder).agg(F.min(at).alias("first_held"), F.max(at).alias("last_held"), F.count(F.lit(1)).alias("n_revs"))


def one_per_day(events: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """The first event of each key and day, in the given order."""
    place = F.row_number().over(Window.partitionBy(key, "day").orderBy(*order))
    return events.withColumn("day", F.to_date(at)).withColumn("__n", place).where("__n = 1").drop("__n")


def carried(rows: DataFrame, key: str, order: list[str], value: Column, name: str) -> DataFrame:
    """The latest non-null value so far, as a heading holds for the lines below it."""
    back = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, True).over(back))
