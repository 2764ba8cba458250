"""A corpus held against its manifest, and a log against the content it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed form: a language tag with optional script and region.
LANGUAGE_TAG = r"^[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|[0-9]{3}))?\z"


def document_findings(manifest: DataFrame, files: DataFrame, renderer: int | None = None) -> DataFrame:
    """Of (doc_id, path, status, renderer_version) against (path): what each record's state and file contradict.

    A removed record's file may stay where a current record owns the same path.
    """
    held = files.select("path").distinct().withColumn("present", F.lit(True))
    live = manifest.where("status = 'current'").select("path").distinct().withColumn("live", F.lit(True))
    seen = manifest.join(held, "path", "left").join(live, "path", "left")
    kind = (
        F.when((F.col("status") == "removed") & F.col("present") & F.col("live").isNull(), "tombstoned_but_present")
        .when((F.col("status") == "current") & F.col("present").isNull(), "missing_document")
        .when((F.col("status") == "current") & (F.col("renderer_version") < F.lit(renderer)), "stale_render")
    )
    return seen.select("doc_id", "path", kind.alias("kind")).where("kind IS NOT NULL")


def declared_findings(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Of current records against (path, declared_id, language): files that name another id or no valid language tag.

    A file that declares nothing is no finding, nor is an empty language.
    """
    met = manifest.where("status = 'current'").select("doc_id", "path").join(files.select("path", "declared_id", "language"), "path")
    other_id = F.col("declared_id") != F.col("doc_id")
    no_tag = (F.col("language") != "") & ~F.col("language").rlike(LANGUAGE_TAG)
    kinds = F.array_compact(F.array(F.when(other_id, "identity_mismatch"), F.when(no_tag, "malformed_language")))
    return met.select("doc_id", "path", F.explode(kinds).alias("kind"))


def snapshot_findings(observed: DataFrame, tombstones: DataFrame, blobs: DataFrame) -> DataFrame:
    """Of (sha, at), (sha, at) and (sha, actual): each hash that the log and the content explain differently.

    missing or removed (observed, no content, without or with a tombstone),
    mismatched (content of another hash), orphan (content never observed),
    unremoved (content in spite of a tombstone), unknown_tombstone (never
    observed), late (observed after its tombstone). A hash may have several.
    """
    def last(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("sha").agg(F.max("at").alias(name))

    held = blobs.groupBy("sha").agg(F.max(F.coalesce(F.col("actual") != F.col("sha"), F.lit(True))).alias("differs"))
    rows = last(observed, "seen").join(last(tombstones, "retired"), "sha", "full_outer").join(held, "sha", "full_outer")
    seen, retired, there = F.col("seen").isNotNull(), F.col("retired").isNotNull(), F.col("differs").isNotNull()
    kinds = F.array_compact(
        F.array(
            F.when(seen & ~there, F.when(retired, "removed").otherwise("missing")),
            F.when(seen & F.col("differs"), "mismatched"),
            F.when(there & ~seen, "orphan"),
            F.when(there & retired, "unremoved"),
            F.when(retired & ~seen, "unknown_tombstone"),
            F.when(F.col("seen") > F.col("retired"), "late"),
        )
    )
    return rows.select("sha", F.explode(kinds).alias("kind"))


def rewritten(now: DataFrame, before: DataFrame, keys: list[str], content: str) -> DataFrame:
    """Rows of the previous release that this one removed or rewrote; new rows are no problem."""
    kept = now.select(*keys, F.struct(content).alias("kept"))
    met = before.select(*keys, content).join(kept, keys, "left")
    kind = F.when(F.col("kept").isNull(), "removed").when(~F.col(content).eqNullSafe(F.col(f"kept.{content}")), "rewritten")
    return met.select(*keys, kind.alias("kind")).where("kind IS NOT NULL")
