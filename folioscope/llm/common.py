"""Helpers that the training-data operators share.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which
every executor can read, so a lost executor costs a re-read and never the job.
Where none is named, ``shared_dir`` raises on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Local mode, which has one machine, may do without a name."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held.getFileSystem(spark._jsc.hadoopConfiguration()), held


def exists(spark: SparkSession, path: str) -> bool:
    files, held = _folder(spark, path)
    return files.exists(held)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table of the shared folder that nothing reads any more."""
    files, held = _folder(spark, path)
    files.delete(held, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def own_row(docs: DataFrame) -> Column:
    """The caller's row as one struct, so that no working column can clash with one of its own; ``select("row.*")`` gives it back."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")


def one_of_each(rows: DataFrame, *key: str) -> DataFrame:
    """Of rows (``row`` and ``key``) that are equal in ``key`` one, the same at every run; combined before they are shuffled."""
    return rows.groupBy(*key).agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")


def text_or_empty(text: str | Column = "text") -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words as an array; one pass of a regular expression in the JVM."""
    return F.array_remove(F.split(text, SPACE), "")


def plan_partitions(df: DataFrame) -> int:
    """Partitions for a key-less repartition: follows the session's setting."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def slabs(sizes: list[int], most: int = 1 << 20) -> Iterator[slice]:
    """Cut rows of these sizes into stretches of at most ``most`` bytes, or one row: what a worker unfolds at once."""
    low = held = 0
    for k, size in enumerate(sizes):
        if held and held + size > most:
            yield slice(low, k)
            low, held = k, 0
        held += size
    if low < len(sizes):
        yield slice(low, len(sizes))


#: Parts of all rows that the sketch of ``heavy`` tells apart at most, so that it stays of fixed size.
MOST_PARTS = 2000


def cut_by_id(rows: DataFrame, batches: int, id_column: str = "doc_id") -> list[DataFrame]:
    """``rows`` in so many parts of ascending ids; null ids last.

    The cuts are quantiles of about 1000 ids of least hash, of any ordered type.
    Where they fall changes the parts' sizes alone.
    """
    if batches < 2:
        return [rows]
    ids = rows.select(F.col(id_column).alias("i")).where("i IS NOT NULL")
    total = ids.count()
    limit = -(2**63) + 2**64 * 1000 // max(total, 1000)
    sample = ids if total <= 2000 else ids.where(F.xxhash64("i") < F.lit(limit))
    held = [r["i"] for r in sample.distinct().orderBy(F.xxhash64("i")).limit(2000).collect()]
    held.sort()
    cuts = sorted({held[len(held) * k // batches] for k in range(1, batches)}) if held else []
    if not cuts:
        return [rows]
    at = F.col(id_column)
    inner = [rows.where((at >= F.lit(a)) & (at < F.lit(b))) for a, b in zip(cuts, cuts[1:])]
    return [rows.where(at < F.lit(cuts[0])), *inner, rows.where((at >= F.lit(cuts[-1])) | at.isNull())]


def heavy(rows: DataFrame, key: str, parts: int) -> list:
    """Values of ``key`` that may hold over 1/``parts`` of the rows, at most 2 * ``parts`` of them.

    A frequent-items sketch over all rows: each task sends one sketch of fixed
    size. It errs by far less than a share, so no heavy value is missed.
    """
    parts = min(parts, MOST_PARTS)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {2 * parts}, {100 * parts})").alias("top")).first()
    return sorted(r["item"] for r in found["top"] or [] if r["item"] is not None and r["count"] * parts > found["n"])


def first_by_hash(docs: DataFrame, rows: int, total: int, shown: Column) -> list:
    """``shown`` of the ``rows`` documents of least hash, of ``total``.

    Most rows are dropped before tasks send their own, so the driver gets about
    twice ``rows`` however many tasks there are; only where ids repeat so much
    that too few are left do all tasks send.
    """

    def least(of: DataFrame) -> list:
        # what is shown is made in the tasks, of the few rows that are left
        told = of.select("doc_id", shown.alias("shown"))
        return [r["shown"] for r in told.orderBy(F.xxhash64("doc_id"), "doc_id", "shown").limit(rows).select("shown").collect()]

    if total <= 2 * rows:
        return least(docs)
    limit = -(2**63) + 2**64 * 2 * rows // total
    found = least(docs.where(F.xxhash64("doc_id") < F.lit(limit)))
    return found if len(found) == rows else least(docs)
