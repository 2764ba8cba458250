"""Places in one order over all rows, without bringing them together, and what many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Bits of a row's number within its task (Spark's own).
TASK_BITS = 33


def heavy(rows: DataFrame, key: str, parts: int) -> list:
    """Values of ``key`` that may be in over 1/``parts`` of the rows, at most 2 * ``parts`` of them.

    A frequent-items sketch over all rows: each task sends one of fixed size, and it errs by far less than a share.
    """
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k({key}, {2 * parts}, {100 * parts})").alias("top")).first()
    return sorted(r["item"] for r in found["top"] or [] if r["item"] is not None and r["count"] * parts > found["n"])


def numbered(rows: DataFrame, order: list[str], place: str, weight: Column | None = None, before: str | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0 on, by ``order``; with ``weight``, also the sum of it over earlier rows as ``before``.

    Rows are dealt to tasks by ranges of ``order``; a row's place is its place in
    its task and the number of rows in earlier tasks, of which there is one number
    a task. Rows equal in ``order`` are placed as they come.
    """
    taken = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    held = written(taken.withColumn("__weight", (weight if weight is not None else F.lit(0)).cast("long")), "numbered").withColumn("__task", F.shiftright("__at", TASK_BITS))
    each = held.groupBy("__task").agg(F.count(F.lit(1)).alias("__rows"), F.sum("__weight").alias("__sum"))
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = each.select("__task", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__rows", "__sum")))
    met = held.join(written(shifts, "numbered-tasks"), "__task")
    first = F.shiftleft("__task", TASK_BITS)
    out = met.withColumn(place, F.col("__at") - first + F.col("__rows_before"))
    if before:
        inside = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn(before, F.coalesce(F.sum("__weight").over(inside), F.lit(0)) + F.col("__sum_before"))
    return out.drop("__at", "__weight", "__task", "__rows_before", "__sum_before")
