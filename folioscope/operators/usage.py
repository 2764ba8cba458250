"""Usage by hour and its roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(value: str, share: float) -> Column:
    """The value at rank ceil(share * n), one that occurs; never interpolated."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def hourly(calls: DataFrame, at: str, outcome: str, duration: str, who: str, failed: str) -> DataFrame:
    """Per hour: calls, failures, nearest-rank latencies of the calls that did not fail, distinct callers."""
    rows = calls.withColumn("hour", F.date_trunc("hour", at)).withColumn("served", F.when(F.col(outcome) != failed, F.col(duration)))
    return rows.groupBy("hour").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col(outcome) == failed).alias("errors"),
        F.round(nearest_rank("served", 0.5), 1).alias("p50"),
        F.round(nearest_rank("served", 0.95), 1).alias("p95"),
        F.countDistinct(who).alias("callers"),
    )


def outcome_counts(calls: DataFrame, at: str, outcome: str) -> DataFrame:
    """Per hour, a map from outcome to its count, keys in order."""
    per = calls.groupBy(F.date_trunc("hour", at).alias("hour"), outcome).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(outcome), F.col("n"))))
    return per.groupBy("hour").agg(F.map_from_entries(pairs).alias("by_outcome"))


def rolled_up(hours: DataFrame) -> DataFrame:
    """Days from hours: counts add up, distinct callers and latencies do not, so the largest stands."""
    return hours.groupBy(F.to_date("hour").alias("day")).agg(
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        F.max("p95").alias("worst_p95"),
        F.max("callers").alias("most_callers"),
        F.count(F.lit(1)).alias("hours"),
    )
