"""Connected components of a graph of links, by star contraction.

Each round points every node's larger neighbours at its smallest one, then
every node's smaller neighbours likewise, until nothing changes. Rounds are
joins and grouped minima written to the shared folder; no component is ever
gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _mark(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` of a, b (same ordered type, a <> b) to node, component: the smallest node reachable.

    Nodes without an edge do not appear. Repeated edges are harmless.
    """
    now = written(_small_star(edges.select("a", "b")), "stars")
    mark = _mark(now)
    while mark[0]:
        following = written(_small_star(_large_star(now)), "stars")
        new = _mark(following)
        if new == mark:
            break
        now, mark = following, new
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
