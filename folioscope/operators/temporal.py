"""Whether dated facts hold at a date, with three answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class of facts whose source says that no date is set yet.
PENDING = "pending_indeterminate"


def in_force(valid_from: Column, marker_class: Column, at: Column) -> Column:
    """in_force, not_in_force or indeterminate: a date decides, then a pending marker; anything else is open."""
    return (
        F.when(valid_from <= at, "in_force")
        .when(valid_from.isNotNull() | (marker_class == PENDING), "not_in_force")
        .otherwise("indeterminate")
    )


def _answer(status: str, reason: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


def _beyond() -> Column:
    return _answer("indeterminate", "beyond_knowledge_horizon")


def evaluated(valid_from: Column, marker_class: Column, at: Column, horizon: Column) -> Column:
    """Status and reason of a fact known up to ``horizon``; only facts without a date depend on it."""
    return (
        F.when(valid_from <= at, _answer("in_effect"))
        .when(valid_from.isNotNull(), _answer("not_in_effect"))
        .when(at > horizon, _beyond())
        .when(marker_class == PENDING, _answer("not_in_effect"))
        .otherwise(_answer("indeterminate"))
    )


def never_in_force(at: Column, horizon: Column) -> Column:
    """Status and reason of "was never brought into force", which its source knows up to ``horizon``."""
    return F.when(at > horizon, _beyond()).otherwise(_answer("not_in_effect"))
