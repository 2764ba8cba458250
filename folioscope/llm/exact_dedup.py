"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one
row per digest (combined before the shuffle, so a text that fills a third of
the batch costs one row per task), anti-joined with the index by sort-merge
join, and appended. Buckets of the index are never shuffled again.

Defined results: a null text counts as empty; empty texts equal each other;
rows that repeat a doc_id share its verdict, but of rows that repeat id and text
``keep_first`` keeps one; a null doc_id sorts last, so it
stays only where no row of its group has an id; ids may be of any ordered type;
columns of any name are kept as they are; very long texts are hashed whole; an
empty table gives no rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, cut_by_id, documents, exists, one_of_each, own_row, shared_dir, text_or_empty, written

#: Buckets of an index at least, digests a bucket is made for, and Spark's own bound on buckets.
BUCKETS, BUCKET_DIGESTS, MOST_BUCKETS = 16, 10_000_000, 100_000
#: Digests with over this part of the rows are told from a table of at most so many rows.
HEAVY_PARTS = 200


def normalised(text: str | Column = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), SPACE, " ")


def digest_of(text: str | Column = "text") -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """``digest, keep_id, n`` of every batch seen, in the shared folder.

    The number of buckets and the type of ids are kept beside the index, so it is
    opened again by its path alone; other values than the kept ones are refused.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str | None = None):
        self.spark, self.path = spark, path
        asked = {"buckets": buckets, "id_type": id_type}
        if exists(spark, f"{path}-settings"):
            kept = json.loads(spark.read.text(f"{path}-settings").first()[0])
            for name, value in asked.items():
                if value is not None and value != kept[name]:
                    raise ValueError(f"the index has {name} {kept[name]}, not {value}")
        elif exists(spark, path):
            raise ValueError(f"no settings beside the index at {path}")
        else:
            kept = {"buckets": buckets or BUCKETS, "id_type": id_type or "bigint"}
            spark.range(1).select(F.lit(json.dumps(kept)).alias("value")).coalesce(1).write.text(f"{path}-settings")
        self.buckets, self.id_type = kept["buckets"], kept["id_type"]
        self.table = f"digests_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id {self.id_type}, n BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    @classmethod
    def fresh(cls, digests: DataFrame) -> "DigestIndex":
        """A new index for about as many digests as ``digests`` has."""
        spark = digests.sparkSession
        buckets = min(MOST_BUCKETS, max(BUCKETS, -(-digests.count() // BUCKET_DIGESTS)))
        return cls(spark, f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", buckets, digests.schema["doc_id"].dataType.simpleString())

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def add(self, digests: DataFrame) -> DataFrame:
        """Append a batch of (doc_id, digest); returns the digests new to the index.

        A digest the index has is appended with the count alone: its first
        keeper stays.
        """
        batch = written(
            digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")), "batch"
        )
        seen = self.read().select("digest")
        fresh = batch.join(seen.hint("merge"), "digest", "left_anti")
        fresh = written(fresh.select("digest", "keep_id", "n"), "fresh")
        again = batch.join(fresh.select("digest"), "digest", "left_anti")
        again = again.select("digest", F.lit(None).cast(batch.schema["keep_id"].dataType).alias("keep_id"), "n")
        out = fresh.unionByName(again).repartition(self.buckets, "digest")
        (
            out.write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.table)
        )
        return fresh

    def groups(self) -> DataFrame:
        """One row per digest: who stays and how many rows there were."""
        return self.read().groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))


def verdicts(docs: DataFrame, index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """Every row of ``docs`` with the row of its group that stays.

    Batches are of ascending doc_id, as days of a crawl would come.
    """
    digests = written(docs.select("doc_id", digest_of().alias("digest")), "digests")
    index = index or DigestIndex.fresh(digests)
    for batch in cut_by_id(digests, batches):
        index.add(batch)
    groups = index.groups()
    # fewer digests than HEAVY_PARTS hold so many rows each; their rows meet a table of that size and are not shuffled
    many = digests.count() // HEAVY_PARTS
    crowds = written(groups.where(F.col("group_size") > many) if many else groups.limit(0), "crowds")
    heavy = [r["digest"] for r in crowds.where(F.col("group_size") > many).select("digest").collect()] if many else []
    crowded = F.col("digest").isin(heavy)
    told = digests.where(~crowded).join(groups, "digest")
    told = told.unionByName(digests.where(crowded).join(F.broadcast(crowds), "digest"))
    return told.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns.

    Rows are told from a table of those that go by a sort-merge join, which shuffles each text once.
    Rows that repeat both the id and the text that stay are one document, and
    one of them stays; only such rows are gathered.
    """
    digests = written(docs.select("doc_id", digest_of().alias("digest")), "digests")
    keepers = DigestIndex.fresh(digests).add(digests).select("digest", "keep_id")
    gone = digests.join(keepers, "digest").where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    gone = written(gone.select(F.col("doc_id").alias("gone_id"), F.col("digest").alias("gone")).distinct(), "gone")
    again = digests.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select(F.col("doc_id").alias("again_id"), F.col("digest").alias("again")), "again")
    rows = docs.select(own_row(docs), digest_of().alias("digest"))
    goes = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (F.col("digest") == F.col("gone"))
    # as many rows go as there are copies, so their table grows with the input: one plan for every size
    kept = rows.join(gone.hint("merge"), goes, "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    repeats = F.col("row.doc_id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again"))
    # a digest that stays has one id
    return kept.join(again, repeats, "left_anti").select("row.*").unionByName(one_of_each(kept.join(again, repeats, "left_semi"), "digest"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir), batches=2)


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
