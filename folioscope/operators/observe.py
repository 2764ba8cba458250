"""Observation logs: first and last seen, runs, back-off, corrections and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in hours: the first wait and the ceilings after failures and unchanged checks.
WAIT, CEILING_FAILED, CEILING_UNCHANGED, DOUBLINGS = 24, 48, 168, 8
#: Client errors that may pass: timeouts and throttling.
PASSING = (408, 425, 429)


def first_seen(events: DataFrame, keys: list[str], at: str, zone: str = "Europe/Oslo") -> DataFrame:
    out = events.groupBy(*keys).agg(F.min(at).alias("first_seen"))
    return out.withColumn("first_day", F.to_date(F.from_utc_timestamp("first_seen", zone)))


def last_seen(events: DataFrame, keys: list[str], at: str, failed: Column) -> DataFrame:
    """When each key was last seen, what its newest row says, and whether every row failed."""
    return events.groupBy(*keys).agg(
        F.max(F.when(~failed, F.col(at))).alias("last_ok"),
        F.max(at).alias("last_any"),
        F.bool_and(failed).alias("all_failed"),
        F.count_if(failed).alias("n_failed"),
    )


def failure_runs(events: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Each failure with how many in a row it ends; a success clears the run."""
    line = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("failed", failed)
    since = F.sum((~F.col("failed")).cast("int")).over(line)
    run = F.count_if("failed").over(Window.partitionBy(key, "__since").orderBy(*order))
    return marked.withColumn("__since", since).withColumn("run_length", run).where("failed").drop("__since")


def backoff_hours(consecutive: Column, ceiling: int = CEILING_FAILED) -> Column:
    """A day, doubling, up to the ceiling."""
    steps = F.least(F.greatest(consecutive - 1, F.lit(0)), F.lit(DOUBLINGS))
    return F.least(F.lit(float(ceiling)), F.lit(float(WAIT)) * F.pow(F.lit(2.0), steps))


def due(states: DataFrame, now: str) -> DataFrame:
    """Whether a key with its latest failure and run length may be tried again at ``now``."""
    hours = backoff_hours(F.col("run_length"))
    waited = (F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp(F.col("last_failure").cast("timestamp"))) / 3600.0
    return states.withColumn("wait_hours", hours).withColumn("due", waited >= hours)


def composition(records: DataFrame, by: list[str], kind: str, lost: str) -> DataFrame:
    """Counts of records and the share lost; nothing observed counts as no loss."""
    out = records.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(kind) == lost).alias("n_lost"))
    return out.withColumn("loss_rate", F.round(F.coalesce(F.try_divide("n_lost", "n"), F.lit(0.0)), 6))


def url_property(http_status: Column) -> Column:
    """A lasting client error belongs to the address, not to the moment."""
    return http_status.between(400, 499) & ~http_status.isin(*PASSING)


def dropped_triggers(spans: DataFrame, instants: DataFrame, key: str) -> DataFrame:
    """Instants strictly inside a span, with the first such span.

    Spans are filed under every day they touch, so instants meet the spans of
    their day by an equi-join.
    """
    days = F.explode(F.sequence(F.to_date("started"), F.to_date("ended"))).alias("day")
    filed = spans.select(key, "started", "ended", days)
    at = instants.withColumn("day", F.to_date("instant"))
    inside = at.join(filed, "day").where("instant > started AND instant < ended")
    return inside.groupBy("instant").agg(F.min(F.struct("started", key)).alias("f"), F.count(F.lit(1)).alias("n_spans")).select("instant", F.col(f"f.{key}").alias(key), "n_spans")


def corrected(records: DataFrame, corrections: DataFrame, rounds: int = 64) -> DataFrame:
    """Follow corrections (retracts, replaced_by) to the record in force. Where they lead into a cycle no record is in force, and ``in_force`` is null.

    Chains are halved in each round by joining the map with itself, so a chain of n takes about log n joins.
    """
    from .graph import chased_all

    ends = chased_all(corrections.select(F.col("retracts").alias("a"), F.col("replaced_by").alias("b")), rounds)
    met = records.join(ends.select(F.col("a").alias("record_id"), F.col("b").alias("in_force"), "cyclic"), "record_id", "left")
    return met.withColumn("in_force", F.when(F.col("cyclic").isNull(), F.col("record_id")).otherwise(F.col("in_force"))).drop("cyclic")


def unpaired_corrections(retractions: DataFrame, refilings: DataFrame) -> DataFrame:
    """Corrections of which one half is missing."""
    both = retractions.select("correction_id", F.lit(True).alias("r")).join(
        refilings.select("correction_id", F.lit(True).alias("f")), "correction_id", "full_outer"
    )
    kind = F.when(F.col("r").isNull(), "no_retraction").otherwise("no_refiling")
    return both.where("r IS NULL OR f IS NULL").select("correction_id", kind.alias("kind"))


def content_runs(sightings: DataFrame, key: str, order: list[str], at: str, digest: str) -> DataFrame:
    """Length of the unchanged run that each sighting ends; one that is older than an earlier record resets it to 0.

    ``order`` is the log's order, ``at`` the time observed.
    """
    line = Window.partitionBy(key).orderBy(*order)
    newest = F.max(at).over(line.rowsBetween(Window.unboundedPreceding, -1))
    late = F.coalesce(F.col(at) < newest, F.lit(False))
    marked = sightings.withColumn("late", late)
    kept = F.last(F.when(~F.col("late"), F.col(digest)), True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.col("late") | F.coalesce(kept != F.col(digest), F.lit(True))
    run = Window.partitionBy(key, "__run").orderBy(*order)
    return (
        marked.withColumn("__run", F.sum(changed.cast("int")).over(line))
        .withColumn("run_length", F.row_number().over(run) - F.when(F.max("late").over(run), 1).otherwise(0))
        .drop("__run")
    )
