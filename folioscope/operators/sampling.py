"""Deterministic samples, capped selections and seat allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SLICE_DIGITS = 4


def hash_sample(rows: DataFrame, key: str, seed: str, rate: float) -> DataFrame:
    """The ceil(rate * n) rows with the least digest of seed and key.

    The digests' first ``SLICE_DIGITS`` digits are counted, at most 65,536 counts.
    Slices below the one where the sample ends are taken by a compare; that one
    alone is sorted.
    """
    ranked = rows.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(seed), F.col(key).cast("string")), 256))
    part = F.substring("digest", 1, SLICE_DIGITS)
    counts = sorted((r["s"], r["n"]) for r in ranked.groupBy(part.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect())
    left = -int(-sum(n for _, n in counts) * rate // 1)
    for last, n in counts:
        if left <= n:
            return ranked.where(part < last).unionByName(ranked.where(part == last).orderBy("digest", key).limit(left))
        left -= n
    return ranked.limit(0)


def capped(rows: DataFrame, category: str, provision: str, order: str, cap: int, target: int) -> DataFrame:
    """Per category in order, at most ``cap`` of a provision, up to ``target`` in all."""
    inner = F.row_number().over(Window.partitionBy(category, provision).orderBy(order))
    outer = F.row_number().over(Window.partitionBy(category).orderBy(order))
    return rows.withColumn("__n", inner).where(F.col("__n") <= cap).withColumn("place", outer).where(F.col("place") <= target).drop("__n")


def seats(counts: DataFrame, key: str, n: str, size: int) -> DataFrame:
    """Largest-remainder allocation of ``size`` seats; ties by key."""
    total = F.sum(n).over(Window.partitionBy())
    quota = F.col(n) * size
    base = counts.withColumn("total", total).withColumn("floor", F.expr(f"({n} * {size}) div total")).withColumn("rest", F.pmod(quota, F.col("total")))
    left = F.lit(size) - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("rest"), key))
    return base.withColumn("left", left).withColumn("place", place).select(
        key, n, (F.col("floor") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).cast("long").alias("seats")
    )


def first_of(rows: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key, by a grouped minimum: no group is sorted or gathered."""
    held = rows.withColumn("__key", key)
    return held.groupBy("__key").agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in order])).alias("r")).select("r.*")


def trap_ids(ids: DataFrame, act: str, number: str) -> DataFrame:
    """Numbers that an act lacks though their neighbours exist: gaps up to its largest, and the one after it.

    Each number looks at the next one alone, so an act's numbers are never gathered.
    """
    following = F.lead(number).over(Window.partitionBy(act).orderBy(number))
    steps = ids.distinct().withColumn("next", following)
    gaps = F.when(F.col("next") > F.col(number) + 1, F.sequence(F.col(number) + 1, F.col("next") - 1)).when(F.col("next").isNull(), F.array(F.col(number) + 1))
    kind = F.when(F.col("next").isNull(), "overrun").otherwise("gap")
    return steps.select(act, kind.alias("kind"), F.explode(gaps).alias(number)).select(act, number, "kind")
