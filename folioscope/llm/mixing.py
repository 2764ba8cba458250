"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of documents in hashed order and every document may be
served twice. A copy's virtual finish time is the words its source has served
when it ends, divided by the source's target; copies are served in the order of
that time until the budget of words is spent, so that each source comes within
about one document of its target.

Running sums never gather a source in one task: a source of n documents is cut
by its hash into about sqrt(n) slices, slices are summed, and a document's place
is its slice's start plus its place in the slice. The point where the budget
ends is found in the same way, from slices of virtual time.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own, last in order; rows that repeat are documents
of their own here; where there are no words every target is 0; ids may be of any
type that casts to text; columns of any name are kept as they are; a very long
text is one document, taken whole or not; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, own_row, text_or_empty, written

#: Weights by the sources' order, repeating.
WEIGHTS = (5, 2, 1)
#: Budget as a share of all words, and the most that a document is repeated.
BUDGET_NUM, BUDGET_DEN, MOST = 3, 2, 2
HASH_BITS = 52


def targets(sizes: DataFrame) -> DataFrame:
    """One row per source: its size and target, by filling to a common level.

    ``sizes`` has source, sk (a null-free source key) and size.
    """
    per = sizes.groupBy("sk", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(rank, F.lit(len(WEIGHTS))) + 1).cast("long")
    unit = 1
    for w in WEIGHTS:
        unit *= w
    fill = Window.orderBy(F.col("source_size") * (F.lit(unit) / F.col("weight")).cast("long"), "sk")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (
        per.withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("full", F.coalesce(F.sum(F.col("source_size") * MOST).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rest))
        # BUDGET_DEN times what is left for this source and those after it
        .withColumn("left", F.col("total") * BUDGET_NUM - F.col("full") * BUDGET_DEN)
        .withColumn("capped", F.col("source_size") * MOST * BUDGET_DEN * F.col("open") <= F.col("left") * F.col("weight"))
    )
    first = F.min(F.when(~F.col("capped"), F.struct("full", "open", "left"))).over(Window.partitionBy())
    shared = (F.col("weight") * F.col("f.left")).cast("double") / (F.col("f.open") * BUDGET_DEN).cast("double")
    return level.withColumn("f", first).select(
        "sk",
        "n_docs",
        "source_size",
        "total",
        # after the first source below its cap, none is capped
        F.when(F.col("capped"), (F.col("source_size") * MOST).cast("double")).otherwise(shared).alias("target"),
    )


def place_of(seed: str) -> Column:
    """Where a document stands in its source's queue."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        source_key().alias("sk"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        place_of(seed).alias("place"),
    )


def queued(sizes: DataFrame) -> DataFrame:
    """Each document with the words its source serves before it in one round."""
    by_source = written(targets(sizes), "targets")  # so that its size is known when the join is planned
    share = F.conv(F.substring("place", 1, HASH_BITS // 4), 16, 10).cast("double") / F.lit(float(2**HASH_BITS))
    rows = (
        sizes.join(by_source, "sk")
        .withColumn("slice", F.floor(share * F.ceil(F.sqrt("n_docs"))))
        .drop("n_docs")
    )
    sums = rows.groupBy("sk", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("sk").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sk", "slice", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sk", "slice").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, ["sk", "slice"]).select(
        "doc_id", "sk", "size", "place", "source_size", "target", "total",
        (F.col("start") + F.sum("size").over(inside)).alias("served"),
    )


def served(queue: DataFrame) -> DataFrame:
    """``queue`` with ``copies``: how often each document is taken.

    ``queue`` is a written table: it is read for the slices of virtual time,
    for the slice where the budget ends, and for the result.
    """
    def finish(copy: int):
        return F.when(F.col("target") > 0, (F.col("served") + F.col("source_size") * copy).cast("double") / F.col("target"))

    def key(copy: int):
        return F.struct(finish(copy).alias("t"), F.col("sk"), F.col("place"), F.lit(copy).alias("copy"))

    head = queue.agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).first()
    if not head.n or not head.total:
        return queue.withColumn("copies", F.lit(0))
    slices = max(1, int((MOST * head.n) ** 0.5))
    copies = queue.where(F.col("size") > 0).select(
        "size", F.explode(F.array(*(key(c) for c in range(MOST)))).alias("key")
    ).withColumn("slice", F.floor(F.col("key.t") * slices))
    order = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    spent = copies.groupBy("slice").agg(F.sum("size").alias("words")).withColumn("spent", F.sum("words").over(order))
    over = (F.col("spent") * BUDGET_DEN) > head.total * BUDGET_NUM
    at = spent.where(over).orderBy("slice").select("slice", (F.col("spent") - F.col("words")).alias("before")).first()
    if at is None:
        return queue.withColumn("copies", F.when(F.col("size") > 0, MOST).otherwise(0))
    run = Window.orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = copies.where(F.col("slice") == at.slice).withColumn("spent", F.sum("size").over(run) + at.before)
    cut = last.where(over).agg(F.min("key").alias("cut"))
    # one row by construction
    marked = queue.crossJoin(F.broadcast(cut))
    taken = sum((F.when(key(c) < F.col("cut"), 1).otherwise(0) for c in range(MOST)), F.lit(0))
    return marked.withColumn("copies", F.when(F.col("size") > 0, taken).otherwise(0)).drop("cut")


def plan(docs: DataFrame, seed: str = "mix") -> DataFrame:
    return served(written(queued(written(sized(docs, seed), "sizes")), "queue"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, repeated as taken.

    A source serves its documents by place, so for each copy there is a last
    place that is taken: one row per source tells every document's copies, and
    texts are not shuffled. Rows of one source that share a doc_id share a
    place, and are taken as often as the one taken most.
    """
    taken = plan(docs, seed).where("copies > 0")
    last = [F.max(F.when(F.col("copies") > c, F.col("place"))).alias(f"last{c}") for c in range(MOST)]
    bounds = written(taken.groupBy("sk").agg(*last), "bounds")
    has_words = F.rlike(text_or_empty(), F.lit(WORD))
    rows = docs.where(has_words).select(own_row(docs), source_key().alias("sk"), place_of(seed).alias("place"))
    copies = sum((F.when(F.col("place") <= F.col(f"last{c}"), 1).otherwise(0) for c in range(MOST)), F.lit(0))
    return rows.join(bounds, "sk").withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix:' || CAST(doc_id AS VARCHAR)) AS place,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 10 // weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS filled,
    CAST(sum(weight) OVER (ORDER BY source_size * 10 // weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open FROM r
), c AS (SELECT *, 4 * source_size * open <= (3 * total - 2 * filled) * weight AS capped FROM f
), lvl AS (SELECT filled, open, 3 * total - 2 * filled AS remaining FROM c WHERE NOT capped ORDER BY filled, open LIMIT 1
), t AS (
  SELECT source, source_size, total, CASE WHEN capped THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * (SELECT remaining FROM lvl) AS DOUBLE) / CAST(2 * (SELECT open FROM lvl) AS DOUBLE) END AS target FROM c
), q AS (
  SELECT d.doc_id, d.source, d.place, d.size, t.source_size, t.target, t.total,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id) AS BIGINT) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), k AS (
  SELECT doc_id, size, total, source, place, copy, CAST(served + copy * source_size AS DOUBLE) / target AS finish
  FROM q, (VALUES (0), (1)) v(copy) WHERE size > 0
), g AS (
  SELECT doc_id, CASE WHEN 2 * sum(size) OVER (ORDER BY finish, source, place, copy) <= 3 * total THEN size ELSE 0 END AS w FROM k
), m AS (SELECT doc_id, CAST(sum(w) AS BIGINT) AS taken FROM g GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(m.taken, 0) AS taken FROM q LEFT JOIN m USING (doc_id)
"""
