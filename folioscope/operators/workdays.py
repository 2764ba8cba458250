"""Public holidays and working days as a calendar table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Holidays by month and day, and by days from Easter Sunday.
FIXED_DAYS = ("01-01", "05-01", "05-17", "12-25", "12-26")
EASTER_DAYS = (-3, -2, 0, 1, 39, 49, 50)


def easter(year: Column) -> Column:
    """Gregorian Easter Sunday by Oudin's integer rule: the full moon's place in the month, then the Sunday after it."""
    y = year.cast("int")

    def div(a: Column, b: int) -> Column:
        return F.floor(a / b).cast("int")

    century, golden = div(y, 100), y % 19
    moon = (century - div(century, 4) - div(century - div(century - 17, 25), 3) + 19 * golden + 15) % 30
    late = (moon == 29) | ((moon == 28) & (golden > 10))
    moon = F.when(late, moon - 1).otherwise(moon)
    weekday = (y + div(y, 4) + moon + 2 - century + div(century, 4)) % 7
    return F.date_add(F.make_date(y, F.lit(3), F.lit(28)), moon - weekday)


def is_working_day(day: Column) -> Column:
    sunday = easter(F.year(day))
    off = F.date_format(day, "MM-dd").isin(*FIXED_DAYS) | F.datediff(day, sunday).isin(*EASTER_DAYS)
    return (F.weekday(day) < 5) & ~off


def with_working_day(rows: DataFrame, start: str, count: str, name: str = "due") -> DataFrame:
    """Add the ``count``-th working day after ``start``, which itself never counts; none to add gives ``start``, nulls give null.

    The calendar spans the rows' own dates, so its size is bounded by days, not by rows.
    """
    span = rows.agg(F.min(start).alias("a"), F.max(start).alias("b"), F.max(count).alias("n"))
    # at least one day in four works
    last = F.date_add("b", F.greatest("n", F.lit(0)).cast("int") * 4 + 16)
    days = span.where("a IS NOT NULL AND n IS NOT NULL").select(F.explode(F.sequence("a", last)).alias("day"))
    works = days.withColumn("works", is_working_day(F.col("day")))
    numbered = works.withColumn("nth", F.sum(F.col("works").cast("long")).over(Window.orderBy("day")))
    at = numbered.select(F.struct("day", "nth").alias("__from"))
    due = numbered.where("works").select(F.struct("day", "nth").alias("__due"))
    begun = rows.join(at, rows[start] == F.col("__from.day"), "left")
    met = begun.join(due, F.col("__due.nth") == F.col("__from.nth") + F.greatest(F.col(count), F.lit(1)), "left")
    return met.withColumn(name, F.when(F.col(count) <= 0, F.col(start)).when(F.col(count).isNotNull(), F.col("__due.day"))).drop("__from", "__due")
