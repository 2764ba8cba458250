"""Ratio metrics with intervals, stability and eligibility."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The normal quantile, the seed, the number of resamples and the interval's tails.
Z, SEED, RESAMPLES, LOW, HIGH = 1.959963984540054, 42, 10_000, 0.025, 0.975


def ratio(numerator: Column, denominator: Column) -> Column:
    """Ratio of sums; null where there is nothing to divide by."""
    return F.try_divide(F.sum(numerator), F.sum(denominator))


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """The score interval, clamped to 0..1; null without trials."""
    p = F.try_divide(successes, trials)
    z2 = F.lit(Z * Z)
    spread = F.lit(Z) * F.sqrt(p * (1 - p) / trials + z2 / (4 * trials * trials))
    middle, scale = p + z2 / (2 * trials), 1 + z2 / trials
    return F.greatest((middle - spread) / scale, F.lit(0.0)), F.least((middle + spread) / scale, F.lit(1.0))


def ratios(samples: DataFrame, by: list[str], numerator: str, denominator: str) -> DataFrame:
    """Per group: sums, rate and its score interval, to six places."""
    out = samples.groupBy(*by).agg(F.sum(numerator).cast("long").alias("successes"), F.sum(denominator).cast("long").alias("trials"))
    low, high = wilson(F.col("successes").cast("double"), F.col("trials").cast("double"))
    return out.select(
        *by, "successes", "trials",
        F.round(F.try_divide(F.col("successes"), F.col("trials")), 6).alias("rate"),
        F.round(low, 6).alias("ci_low"), F.round(high, 6).alias("ci_high"),
    )


def paired_delta(samples: DataFrame, by: str, arm: str, value: str) -> DataFrame:
    """The rate of arm 1 less that of arm 0 per group; null where an arm is empty."""
    def rate(which: int) -> Column:
        return F.avg(F.when(F.col(arm) == which, F.col(value).cast("double")))

    return samples.groupBy(by).agg(
        F.round(rate(0), 6).alias("control"), F.round(rate(1), 6).alias("treatment"), F.round(rate(1) - rate(0), 6).alias("delta")
    )


def bootstrapped(samples: DataFrame, by: str, numerator: str, denominator: str, resamples: int = RESAMPLES) -> DataFrame:
    """Seeded percentile interval of a ratio of sums, per group.

    Cases are first folded to counts of distinct (numerator, denominator), so a
    group holds few rows however many cases it has.
    """
    folded = samples.groupBy(by, numerator, denominator).agg(F.count(F.lit(1)).alias("n"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        group = group.sort_values([numerator, denominator])
        n = group["n"].to_numpy()
        rng = np.random.default_rng(SEED)
        draws = rng.multinomial(int(n.sum()), n / n.sum(), size=resamples)
        top, bottom = draws @ group[numerator].to_numpy(), draws @ group[denominator].to_numpy()
        rates = np.sort((top / np.where(bottom == 0, np.nan, bottom))[bottom > 0])
        if not len(rates):
            return pd.DataFrame({by: [group[by].iloc[0]], "ci_low": [None], "ci_high": [None]})
        at = [round(q * (len(rates) - 1)) for q in (LOW, HIGH)]
        return pd.DataFrame({by: [group[by].iloc[0]], "ci_low": [float(rates[at[0]])], "ci_high": [float(rates[at[1]])]})

    kind = samples.schema[by].dataType.simpleString()
    return folded.groupBy(by).applyInPandas(run, f"{by} {kind}, ci_low double, ci_high double")


def spread(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least, largest and sample deviation, nulls aside."""
    return values.groupBy(*by).agg(
        F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.stddev_samp(value), 6).alias("sd")
    )


def flipped(outcomes: DataFrame, case: str, repeat: str, outcome: str, repeats: int) -> DataFrame:
    """Cases whose outcome differs between repeats, or that lack one."""
    per = outcomes.groupBy(case).agg(F.countDistinct(repeat).alias("n_repeats"), F.countDistinct(outcome).alias("n_outcomes"))
    return per.where((F.col("n_repeats") != repeats) | (F.col("n_outcomes") > 1))


def all_passed(verdict: Column) -> Column:
    """Tri-state conjunction as an aggregate: a failure beats an unresolved criterion, which beats a pass."""
    return F.when(F.count_if(verdict == "fail") > 0, False).when(F.count_if(verdict == "unresolved") > 0, None).otherwise(True)


def reordered(values: list, seed: int = SEED) -> list:
    """A seeded shuffle of a short list on the driver."""
    out = list(values)
    random.Random(seed).shuffle(out)
    return out
