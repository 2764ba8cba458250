"""Change detection against a manifest, guards and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups under this many current documents are exempt; removals above this share stop a run.
EXEMPT_UNDER, MOST_REMOVED = 20, 0.10


class MassRemoval(RuntimeError):
    """Too large a share of a dataset would be removed."""


def detected(upstream: DataFrame, manifest: DataFrame) -> DataFrame:
    """doc_id and change: new, removed, changed or unchanged.

    Both sides have doc_id and hash; the manifest also status. Rows of the
    manifest that are not current take no part, so a removed document that
    comes back is new.
    """
    now = upstream.select("doc_id", F.col("hash").alias("up_hash"))
    then = manifest.where("status = 'current'").select("doc_id", F.col("hash").alias("old_hash"))
    kind = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("up_hash").isNull(), "removed")
        .when(F.col("up_hash") != F.col("old_hash"), "changed")
        .otherwise("unchanged")
    )
    return now.join(then, "doc_id", "full_outer").select("doc_id", kind.alias("change"))


def removal_ratios(changes: DataFrame, manifest: DataFrame, by: str) -> DataFrame:
    """Per group: current documents, removals, share, and whether the guard fires."""
    current = manifest.where("status = 'current'").select("doc_id", by)
    gone = changes.where("change = 'removed'").select("doc_id", F.lit(1).alias("gone"))
    out = current.join(gone, "doc_id", "left").groupBy(by).agg(
        F.count(F.lit(1)).alias("n_current"), F.sum(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed")
    )
    ratio = F.col("n_removed") / F.col("n_current")
    return out.withColumn("ratio", F.round(ratio, 6)).withColumn(
        "fires", (F.col("n_current") >= EXEMPT_UNDER) & (ratio > MOST_REMOVED)
    )


def guard(ratios: DataFrame) -> None:
    """Stops the run where a group's guard fires; at most ten are named."""
    fired = ratios.where("fires").limit(10).collect()
    if fired:
        raise MassRemoval(", ".join(f"{r[0]}: {r.n_removed} of {r.n_current}" for r in fired))


def renames(docs: DataFrame) -> DataFrame:
    """Ids that hold the same content: the smallest is where it came from.

    ``docs`` has doc_id and hash. One row per later id, by a grouped minimum
    and an equi-join, never by pairs within a group.
    """
    first = docs.groupBy("hash").agg(F.min("doc_id").alias("from_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return docs.join(first, "hash").where("doc_id > from_id").select("doc_id", "from_id")


def slug_claims(claims: DataFrame) -> DataFrame:
    """Slugs claimed by several ids: the first keeps it, the others get a number."""
    order = Window.partitionBy("slug").orderBy("doc_id")
    place = F.row_number().over(order)
    own = F.when(place == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), place.cast("string")))
    return claims.select("doc_id", own.alias("slug"), place.cast("long").alias("claim"))


def shared_paths(records: DataFrame, path: str, owner: str) -> DataFrame:
    return (
        records.groupBy(path)
        .agg(F.count(F.lit(1)).alias("n_owners"), F.min(owner).alias("first_owner"), F.max(owner).alias("last_owner"))
        .where("n_owners > 1")
    )


def orphans(files: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Rows that no record owns."""
    return files.join(records.select(key).distinct(), key, "left_anti")


def multiset_difference(expected: DataFrame, stored: DataFrame, key: str, item: str) -> DataFrame:
    """Items a key lacks, with how many: counts are compared, so rows need not be paired."""
    want = expected.groupBy(key, item).agg(F.count(F.lit(1)).alias("want"))
    have = stored.groupBy(key, item).agg(F.count(F.lit(1)).alias("have"))
    lacking = F.col("want") - F.coalesce("have", F.lit(0))
    return want.join(have, [key, item], "left").where(lacking > 0).select(key, item, lacking.alias("lacking"))
