"""Exact vector search and quantisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: The bound of a quantised entry and the floor of a search score.
BOUND, FLOOR = 127, 0.25
#: Vectors of a slot, query vectors of a block, those that are multiplied at once, pairs scored at once, and how far below the k-th best a score may be and still round like it.
SLOT, BLOCK, SLAB, PAIRS, MARGIN = 8192, 4096, 128, 1 << 16, 2e-6


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors as doubles with their norm; zero vectors go."""
    return vectors.withColumn("v", doubles(F.col(column))).withColumn("norm", norm(F.col("v"))).where("norm > 0")


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", floor: float | None = None, unique: bool = False) -> DataFrame:
    """The k keys with the highest cosine, ties by key; the floor applies after the limit.

    The query is a literal. Where keys are ``unique``, this is a scan and a top-k
    per task, with no shuffle beyond k rows a task; otherwise a key's best row is
    found first.
    """
    q = F.array(*(F.lit(float(x)) for x in query))
    size = sum(x * x for x in query) ** 0.5
    rows = normed(vectors).select(key, F.round(dot(F.col("v"), q) / (F.col("norm") * size), 6).alias("score"))
    per_key = rows if unique else rows.groupBy(key).agg(F.max("score").alias("score"))
    best = per_key.orderBy(F.desc("score"), key).limit(k)
    return best if floor is None else best.where(F.col("score") >= floor)


def neighbours(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """For a stated set of query vectors (query_id, embedding), the k nearest others by cosine.

    The vectors are dealt over slots and the queries over blocks of bounded size;
    every slot meets every block in a task of its own, as one product of matrices. Of each only what can be among
    the k best is scored (term by term, as ``dot`` does) and shuffled.
    """
    slots, blocks = (max(1, -(-rows.count() // size)) for rows, size in ((vectors, SLOT), (queries, BLOCK)))
    held = normed(queries).select("query_id", F.col("label").alias("wanted"), "v", "norm", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"), _every(slots).alias("slot"))
    dealt = normed(vectors).select("vec_id", "label", "v", "norm", F.pmod(F.xxhash64("vec_id"), F.lit(slots)).alias("slot"), _every(blocks).alias("block"))
    key = {name: rows.schema[name].dataType for name, rows in (("query_id", queries), ("vec_id", vectors))}
    fields = [*(T.StructField(*pair) for pair in key.items()), T.StructField("score", T.DoubleType()), T.StructField("hit", T.BooleanType())]

    def run(found: pa.Table, asked: pa.Table) -> pa.Table:
        # a side without rows has no columns either
        return _best(found, asked, k) if len(found) and len(asked) else none

    none = to_arrow_schema(T.StructType(fields)).empty_table()

    scored = dealt.groupBy("slot", "block").cogroup(held.groupBy("slot", "block")).applyInArrow(run, T.StructType(fields))
    rows = scored.select("query_id", "vec_id", F.round("score", 6).alias("score"), "hit")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def _best(found: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """query_id, vec_id, score and hit of all that can be among the k best of a query: by score to six places, then by id."""
    def matrix(rows: pa.Table) -> np.ndarray:
        held = rows["v"].combine_chunks()
        return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)

    v, q = matrix(found), matrix(asked)
    ids, of = found["vec_id"].to_numpy(), asked["query_id"].to_numpy()
    norms, sizes = found["norm"].to_numpy(), asked["norm"].to_numpy()
    at, to, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
    for low in range(0, len(q), SLAB):
        near = (q[low : low + SLAB] / sizes[low : low + SLAB, None]) @ (v / norms[:, None]).T
        near[of[low : low + SLAB, None] == ids[None, :]] = -np.inf
        least = np.partition(near, max(0, len(v) - k), axis=1)[:, max(0, len(v) - k)]
        rows, columns = np.nonzero((near >= least[:, None] - MARGIN) & (near > -np.inf))
        for part in range(0, len(rows), PAIRS):
            r, c = rows[part : part + PAIRS] + low, columns[part : part + PAIRS]
            # a running sum adds in the order of the entries
            exact = np.cumsum(v[c] * q[r], axis=1)[:, -1] / (norms[c] * sizes[r])
            # scores of half a step round alike, so of each the least ids are enough
            step = np.floor(exact * 2e6)
            order = np.lexsort((ids[c], -step, r))
            fresh = np.r_[True, (np.diff(r[order]) != 0) | (np.diff(step[order]) != 0)]
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
            kept = order[np.arange(len(order)) - begin < k]
            at.append(c[kept])
            to.append(r[kept])
            scores.append(exact[kept])
    c, r = pa.array(np.concatenate(at)), pa.array(np.concatenate(to))
    hit = pc.equal(found["label"].take(c), asked["wanted"].take(r))
    return pa.table({"query_id": asked["query_id"].take(r), "vec_id": found["vec_id"].take(c), "score": np.concatenate(scores), "hit": hit})


def quantised(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """int8 entries and the scale: the largest magnitude over 127, rounded half to even, clipped."""
    v = doubles(F.col(column))
    top = F.aggregate(v, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scaled = vectors.withColumn("scale", top / BOUND)
    entry = F.transform(v, lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.rint(x / F.col("scale")).cast("int"))))
    zeros = F.transform(v, lambda x: F.lit(0))
    return scaled.withColumn("q", F.when(F.col("scale") > 0, entry).otherwise(zeros))


def quantised_at(vector: Column, scale: Column) -> Column:
    """Entries of a vector at a given scale (a float), as bytes."""
    wide = scale.cast("double")
    entry = F.transform(doubles(vector), lambda x: F.greatest(F.lit(-BOUND), F.least(F.lit(BOUND), F.rint(x / wide).cast("int"))).cast("tinyint"))
    return F.when(scale > 0, entry).otherwise(F.transform(vector, lambda x: F.lit(0).cast("tinyint")))


def loudest(vector: Column) -> Column:
    return F.aggregate(doubles(vector), F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))


def quantised_together(rows: DataFrame, document: str, vector: str = "vector") -> DataFrame:
    """``rows`` with ``scale`` and ``row``: all vectors of a document share the scale, a float, of its largest entry."""
    top = rows.groupBy(document).agg((F.max(loudest(F.col(vector))) / BOUND).cast("float").alias("scale"))
    met = rows.join(top, document)
    return met.withColumn("row", quantised_at(F.col(vector), F.col("scale")))


def paid(inputs: DataFrame, prior: DataFrame) -> DataFrame:
    """The inputs (document, text) that must be embedded: those without a row of their document in ``prior``."""
    return inputs.join(prior.select("document", "text"), ["document", "text"], "left_anti")


def incremental(inputs: DataFrame, prior: DataFrame) -> DataFrame:
    """document, text, scale, row and how, byte for byte what ``quantised_together`` gives of all ``inputs`` (document, text, vector).

    ``prior`` (document, text, row, scale) is what was stored. A document keeps
    its scale where a full pass would find the same one: the scale is a positive number, every stored row
    that reaches the bound is still wanted, and no new vector is
    louder. Then stored rows are ``reused`` and only new texts are quantised (``fresh``); else all of
    the document is ``redone``. A document without stored rows is fresh.
    """
    held = prior.select("document", "text", F.col("row").alias("__row"), F.col("scale").alias("__scale"))
    met = inputs.join(held, ["document", "text"], "left")
    at_bound = F.exists("row", lambda x: F.abs(x.cast("int")) == BOUND)
    lost = prior.where(at_bound).join(inputs.select("document", "text"), ["document", "text"], "left_anti").groupBy("document").agg(F.count(F.lit(1)).alias("__lost"))
    kept = prior.groupBy("document").agg(F.max("scale").alias("kept_scale"), F.count_if(at_bound).alias("__loud"))
    fresh = met.where("__row IS NULL").groupBy("document").agg((F.max(loudest(F.col("vector"))) / BOUND).cast("float").alias("__fresh"))
    every = inputs.groupBy("document").agg((F.max(loudest(F.col("vector"))) / BOUND).cast("float").alias("full_scale"))
    told = every.join(kept, "document", "left").join(lost, "document", "left").join(fresh, "document", "left")
    finite = (F.col("kept_scale") > 0) & (F.col("kept_scale") < float("inf"))
    keeps = finite & (F.col("__loud") > 0) & F.col("__lost").isNull() & (F.coalesce("__fresh", F.lit(0.0).cast("float")) <= F.col("kept_scale"))
    scales = told.select("document", F.coalesce(keeps, F.lit(False)).alias("keeps"), "kept_scale", F.when(keeps, F.col("kept_scale")).otherwise(F.col("full_scale")).alias("scale"))
    out = met.join(scales, "document")
    reuse = F.col("keeps") & F.col("__row").isNotNull()
    how = F.when(reuse, "reused").when(F.col("keeps") | F.col("kept_scale").isNull(), "fresh").otherwise("redone")
    return out.select("document", "text", "scale", F.when(reuse, F.col("__row")).otherwise(quantised_at(F.col("vector"), F.col("scale"))).alias("row"), how.alias("how"))


def recall_mrr(ranked: DataFrame, k: int) -> DataFrame:
    """Share of queries with a hit in the first k, and the mean of one over the first hit's rank."""
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return first.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias("recall"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def excluded(manifest: DataFrame, sidecars: DataFrame, space: str, dim: int) -> DataFrame:
    """Why vectors of a document are left out, counted: first reason that holds."""
    rows = manifest.join(sidecars, "doc_id", "left")
    reason = (
        F.when(F.col("vec").isNull(), "missing")
        .when(F.col("space_id").isNull(), "unknown_space")
        .when(F.col("space_id") != space, "different_space")
        .when(F.size("vec") != dim, "wrong_dimension")
        .otherwise("included")
    )
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
