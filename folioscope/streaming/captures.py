"""What a log of captures says of every URL, in keyed state with several values and a timer.

Content and failures of a URL come as rows in the order of the log. Its state is when it
was last seen with content, its newest bytes and how often in a row they came
back the same, how its open run of refusals stands, and when it is overdue.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.observe import PASSING

#: How long after it was last seen a URL is overdue.
DEADLINE = timedelta(hours=36)
SCHEMA = "url string, observed timestamp, sha256 string, unchanged long, hold_outcome string, hold_count long, last_failed timestamp, overdue boolean, in_order boolean"


def is_url_property(outcome: str) -> bool:
    """Whether a failure tells of the URL, as an answer of 4xx does, and not of the moment."""
    return outcome.startswith("http_4") and int(outcome[5:]) not in PASSING


class Step:
    """The fold itself, one row at a time; the stream and the test of one URL's rows share it."""

    def __init__(self, observed=None, content=(None, 0), hold=None):
        self.observed, self.content, self.hold = observed, content, hold

    def take(self, at: datetime, sha256: str | None, outcome: str | None) -> bool:
        """Fold a capture (``sha256``) or a failure (``outcome``); whether it follows what was seen last."""
        if sha256 is None:
            if outcome and is_url_property(outcome):
                self.hold = (outcome, self.hold[1] + 1, max(self.hold[2], at)) if self.hold and self.hold[0] == outcome else (outcome, 1, at)
            return True
        in_order = self.observed is None or at >= self.observed
        kept, unchanged = self.content
        if kept is None:
            self.content = (sha256, 0)
        elif not in_order:
            self.content = (kept, 0)  # an older row cannot go on with a run, and ends it
        else:
            self.content = (sha256, unchanged + 1 if sha256 == kept else 0)
        self.observed, self.hold = max(at, self.observed or at), None
        return in_order


class Captures(StatefulProcessor):
    """Rows (url, number, at, sha256, outcome) by url; emits the state after every row, and once more when the URL falls overdue."""

    def __init__(self, deadline: timedelta = DEADLINE):
        self.deadline = deadline

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.observed = handle.getValueState("observed", "at timestamp")
        self.content = handle.getValueState("content", "sha256 string, unchanged long")
        self.hold = handle.getValueState("hold", "outcome string, count long, last timestamp")

    def _held(self) -> Step:
        at = self.observed.get()[0] if self.observed.exists() else None
        return Step(at, tuple(self.content.get()) if self.content.exists() else (None, 0), tuple(self.hold.get()) if self.hold.exists() else None)

    def _row(self, url: str, step: Step, overdue: bool, in_order: bool) -> tuple:
        outcome, count, last = step.hold or (None, None, None)
        return (url, step.observed, *step.content, outcome, count, last, overdue, in_order)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of a batch fold (url, observed, sha256, unchanged) from which the stream goes on."""
        row = initialState.iloc[0]
        self.observed.update((row["observed"].to_pydatetime(),))
        self.content.update((row["sha256"], int(row["unchanged"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (url,) = key
        step, out = self._held(), []
        frames = pd.concat(list(rows)).sort_values("number", kind="stable")
        for at, sha256, outcome in zip(frames["at"], frames["sha256"], frames["outcome"]):
            in_order = step.take(at.to_pydatetime(), sha256 if isinstance(sha256, str) else None, outcome if isinstance(outcome, str) else None)
            out.append(self._row(url, step, False, in_order))
        if step.observed is not None:
            self.observed.update((step.observed,))
            self.content.update(step.content)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((step.observed + self.deadline).timestamp() * 1000))
        if step.hold:
            self.hold.update(step.hold)
        else:
            self.hold.clear()
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield _frame([self._row(key[0], self._held(), True, True)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.strip().split()[0] for c in SCHEMA.split(",")]
    return pd.DataFrame(rows, columns=names).astype({"hold_count": "Int64", "observed": "datetime64[ns]", "last_failed": "datetime64[ns]"})


def capture_states(stream: DataFrame, deadline: timedelta = DEADLINE, initial: DataFrame | None = None) -> DataFrame:
    """The state of each URL after each of its rows, from a stream of (url, number, at, sha256, outcome); ``number`` is the row's place in the log.

    Timers go by the watermark on ``at``, so the stream must have one for URLs to fall overdue.
    The state store must be RocksDB. ``initial`` (url, observed, sha256, unchanged) is where URLs start from.
    """
    return stream.groupBy("url").transformWithStateInPandas(
        Captures(deadline), outputStructType=SCHEMA, outputMode="append", timeMode="eventTime", initialState=initial.groupBy("url") if initial is not None else None
    )


def folded(rows: DataFrame) -> DataFrame:
    """The same of a whole log at once: url, observed, sha256 and unchanged after its last row, in built-in functions.

    Rows are told late by the newest sighting before them; a late row ends a run, the bytes of
    the last row that was not late are kept.
    """
    from pyspark.sql import Window

    line = Window.partitionBy("url").orderBy("number")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    seen = rows.where("sha256 IS NOT NULL").withColumn("late", F.coalesce(F.col("at") < F.max("at").over(before), F.lit(False)))
    kept = seen.withColumn("kept", F.last(F.when(~F.col("late"), F.col("sha256")), ignorenulls=True).over(before))
    fresh = F.col("late") | F.coalesce(F.col("kept") != F.col("sha256"), F.lit(True))
    run = kept.withColumn("run", F.sum(fresh.cast("int")).over(line)).withColumn("nth", F.row_number().over(Window.partitionBy("url", "run").orderBy("number")) - 1)
    last = run.groupBy("url").agg(F.max("at").alias("observed"), F.max_by(F.struct(F.when(F.col("late"), F.col("kept")).otherwise(F.col("sha256")).alias("sha256"), "nth"), "number").alias("l"))
    return last.select("url", "observed", "l.sha256", F.col("l.nth").cast("long").alias("unchanged"))
