"""Scores of answers by two arms over the same cases: metrics, gates, missing pairs and the verdict.

``scores`` has one row per arm ('control', 'treatment') and case: arm, case_id,
category, outcome, passed, criteria (map of criterion to verdict), asserted_h1
(array), asserted_citations, asserted_resolved, asserted_valid, quotes_detected,
quotes_checkable, quotes_verified, unresolved_claims, unattached_quotes and
retrieved. A metric is a numerator and a denominator per case, then a ratio of
sums. A null count is 0; a criterion that is absent was not judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import section_id
from .evalmetrics import HIGH, LOW, RESAMPLES, SEED, wilson

#: The primary metric, and how many pairs may be lost to errors.
PRIMARY, MODEL_ERRORS, SCORER_ERRORS = "unconditional_h1_rate", 5, 2
OUTCOMES = ["PASS", "FAIL", "UNRESOLVED_SEMANTIC", "SCORER_ERROR", "MODEL_ERROR"]
#: Means per answer have no score interval; metrics of the treatment arm have no difference.
MEANS = ["valid_citations_per_answer", "invalid_citations_per_answer"]
TREATED = ["post_direct_retrieval_hallucination_rate"]
#: Draws held at once.
SLAB = 500


def retrieved_directly(calls: Column, slug: Column, section: Column, tool: str) -> Column:
    """Whether a successful call of ``tool`` in an array of calls (name, is_error, slug, section_id) fetched the expected provision."""
    def hit(call: Column) -> Column:
        return ~F.coalesce(call["is_error"], F.lit(False)) & (call["name"] == tool) & (call["slug"] == slug) & (section_id(call["section_id"]) == section_id(section))

    return F.coalesce(F.exists(calls, hit), F.lit(False))


def _count(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast("long")


def _metrics() -> dict[str, tuple[Column, Column]]:
    """Per metric, what holds or is counted, and what it is counted over."""
    one = F.lit(True)
    invented = F.coalesce(F.size("asserted_h1") > 0, F.lit(False))
    cites = _count("asserted_citations") > 0
    misled = F.coalesce(F.col("criteria")["claimed-attribution-not-asserted"] == "fail", F.lit(False))
    premise = F.col("criteria")["false-premise-not-endorsed"]
    passed = F.coalesce(F.col("passed"), F.lit(False))
    valid, resolved = _count("asserted_valid"), _count("asserted_resolved")
    category = F.col("category")
    return {
        PRIMARY: (invented, one),
        "citation_coverage": (cites, one),
        "citation_hallucination_rate": (invented, cites),
        "citation_accuracy": (valid, resolved),
        "valid_citations_per_answer": (valid, one),
        "invalid_citations_per_answer": (resolved - valid, one),
        "misattribution_rate": (misled, category == "C4"),
        "correct_provision_identification": (passed, category.isin("C1", "C2")),
        "quote_fidelity": (_count("quotes_verified"), _count("quotes_checkable")),
        "false_premise_rejection_rate": (premise == "pass", (category == "C6") & (premise != "unresolved")),
        "no_invention_rate_resolved_cases": (passed, (category == "C8") & F.col("passed").isNotNull()),
        "post_direct_retrieval_hallucination_rate": (invented | misled, F.coalesce(F.col("retrieved"), F.lit(False))),
    }


def samples(scores: DataFrame) -> DataFrame:
    """arm, case_id, category, metric, numerator, denominator: twelve rows for each of ``scores``, without a shuffle."""
    rows = []
    for name, (top, bottom) in _metrics().items():
        weight = F.coalesce(bottom.cast("long"), F.lit(0).cast("long"))
        value = F.when(weight == 0, 0).otherwise(F.coalesce(top.cast("long"), F.lit(0).cast("long")))
        rows.append(F.struct(F.lit(name).alias("metric"), value.cast("long").alias("numerator"), weight.alias("denominator")))
    return scores.select("arm", "case_id", "category", F.inline(F.array(*rows)))


def rates(samples: DataFrame, *by: str) -> DataFrame:
    """Sums and rate per arm, metric and ``by``; the score interval where the metric is a proportion, else null."""
    sums = samples.groupBy("arm", "metric", *by).agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"))
    top, bottom = F.col("numerator"), F.col("denominator")
    low, high = wilson(top.cast("double"), bottom.cast("double"))
    fits = ~F.col("metric").isin(MEANS) & (bottom > 0) & (top >= 0) & (top <= bottom)
    return sums.select(
        "arm", "metric", *by, "numerator", "denominator", F.round(F.try_divide(top, bottom), 6).alias("rate"),
        F.round(F.when(fits, low), 6).alias("ci_low"), F.round(F.when(fits, high), 6).alias("ci_high"),
    )


def _draws(counts: np.ndarray) -> Iterator[np.ndarray]:
    """Resamples of cases, as how often each kind of case is drawn."""
    generator, total = np.random.default_rng(SEED), int(counts.sum())
    for low in range(0, RESAMPLES, SLAB):
        yield generator.multinomial(total, counts / total, size=min(SLAB, RESAMPLES - low))


def _interval(values: np.ndarray) -> list[float | None]:
    held = np.sort(values[np.isfinite(values)])
    return [float(held[round(q * (len(held) - 1))]) for q in (LOW, HIGH)] if len(held) else [None, None]


def _resampled(folded: DataFrame, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Per group of ``keys``, the percentile interval of the first ratio of sums less the second, where there is one.

    ``folded`` has ``n`` cases of each kind, so a group holds as many rows as there are kinds.
    """
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([c for pair in pairs for c in pair])
        found = []
        for drawn in _draws(group["n"].to_numpy()):
            with np.errstate(divide="ignore", invalid="ignore"):
                each = [(drawn @ group[top].to_numpy()) / (drawn @ group[bottom].to_numpy()) for top, bottom in pairs]
            found.append(each[0] - each[1] if len(each) == 2 else each[0])
        low, high = _interval(np.concatenate(found))
        return pd.DataFrame([[*group[keys].iloc[0], low, high]], columns=[*keys, "ci_low", "ci_high"])

    fields = ", ".join(f"{k} {folded.schema[k].dataType.simpleString()}" for k in keys)
    return folded.groupBy(*keys).applyInPandas(run, f"{fields}, ci_low double, ci_high double")


def mean_intervals(samples: DataFrame) -> DataFrame:
    """arm, metric, ci_low, ci_high of the means per answer, by seeded resamples of the cases."""
    folded = samples.where(F.col("metric").isin(MEANS)).groupBy("arm", "metric", "numerator", "denominator").agg(F.count(F.lit(1)).alias("n"))
    return _resampled(folded, ["arm", "metric"], [("numerator", "denominator")])


def _in(arm: str, value: Column) -> Column:
    return F.when(F.col("arm") == arm, value)


def differences(samples: DataFrame, *by: str) -> DataFrame:
    """metric, ``by``, control, treatment, delta (control less treatment; null where an arm has no rate)."""
    def rate(arm: str) -> Column:
        return F.try_divide(F.sum(_in(arm, F.col("numerator"))), F.sum(_in(arm, F.col("denominator"))))

    treated = F.col("metric").isin(TREATED)
    both = samples.groupBy("metric", *by).agg(rate("control").alias("c"), rate("treatment").alias("t"))
    control = F.when(~treated, F.col("c"))
    return both.select("metric", *by, F.round(control, 6).alias("control"), F.round("t", 6).alias("treatment"), F.round(control - F.col("t"), 6).alias("delta"))


def difference_intervals(samples: DataFrame) -> DataFrame:
    """metric, ci_low, ci_high of the difference: both arms are scored on the same resample of cases."""
    def of(arm: str, name: str) -> Column:
        return F.max(_in(arm, F.col(name))).alias(f"{arm}_{name}")

    held = samples.where(~F.col("metric").isin(TREATED))
    parts = [(arm, name) for arm in ("control", "treatment") for name in ("numerator", "denominator")]
    paired = held.groupBy("metric", "case_id").agg(*(of(*part) for part in parts))
    names = [f"{arm}_{name}" for arm, name in parts]
    return _resampled(paired.groupBy("metric", *names).agg(F.count(F.lit(1)).alias("n")), ["metric"], [tuple(names[:2]), tuple(names[2:])])


def _fates(scores: DataFrame) -> DataFrame:
    """case_id and what became of the pair: scored, model_error or scorer_error. A case that is not once in each arm is an error."""
    def hit(outcome: str) -> Column:
        return F.bool_or(F.col("outcome") == outcome)

    once = (F.count_if(F.col("arm") == "control") == 1) & (F.count_if(F.col("arm") == "treatment") == 1) & (F.count(F.lit(1)) == 2)
    fate = F.when(hit("MODEL_ERROR"), "model_error").when(hit("SCORER_ERROR"), "scorer_error").otherwise("scored")
    return scores.groupBy("case_id").agg(F.when(once, fate).otherwise(F.raise_error(F.lit("the two arms cover different cases"))).alias("fate"))


def scored(scores: DataFrame) -> DataFrame:
    """Cases that neither arm lost to an error: pairs are dropped whole."""
    return scores.join(_fates(scores).where("fate = 'scored'"), "case_id", "left_semi")


def eligibility(scores: DataFrame) -> DataFrame:
    """One row: pairs in all, scored, lost to the model and to the scorer, both gates, and whether a verdict may be given."""
    of = {fate: F.count_if(F.col("fate") == fate) for fate in ("scored", "model_error", "scorer_error")}
    counts = _fates(scores).agg(F.count(F.lit(1)).alias("pairs_total"), of["scored"].alias("pairs_scored"), of["model_error"].alias("model_error_pairs"), of["scorer_error"].alias("scorer_error_pairs"))
    model, scorer = F.col("model_error_pairs") <= MODEL_ERRORS, F.col("scorer_error_pairs") <= SCORER_ERRORS
    return counts.select("*", model.alias("model_gate"), scorer.alias("scorer_gate"), (model & scorer).alias("eligible"))


def outcome_counts(scores: DataFrame, *by: str) -> DataFrame:
    """Cases by outcome, per arm and ``by``."""
    return scores.groupBy("arm", *by).agg(*(F.count_if(F.col("outcome") == o).alias(o.lower()) for o in OUTCOMES), F.count(F.lit(1)).alias("total"))


def buckets(scores: DataFrame) -> DataFrame:
    """What could not be judged, per arm: claims, quotes without an act, quotes without a text, cases."""
    return scores.groupBy("arm").agg(
        F.sum(_count("unresolved_claims")).alias("unresolved_claims"),
        F.sum(_count("unattached_quotes")).alias("unattached_quotes"),
        F.sum(_count("quotes_detected") - _count("quotes_checkable")).alias("unverifiable_quotes"),
        F.count_if(F.col("passed").isNull()).alias("cases_unresolved"),
    )


def missingness(scores: DataFrame) -> DataFrame:
    """One row: the primary difference over all pairs, and its bounds if every dropped pair fell to one side.

    ``survives`` is null where no pair was dropped or there is none.
    """
    signed = F.when(F.col("arm") == "control", F.col("numerator")).otherwise(-F.col("numerator"))
    seen = samples(scored(scores)).where(F.col("metric") == PRIMARY).agg(F.coalesce(F.sum(signed), F.lit(0)).alias("observed"))
    gates = eligibility(scores)
    total, lost = F.col("pairs_total"), F.col("pairs_total") - F.col("pairs_scored")
    low, delta, high = (F.try_divide(F.col("observed") + lost * side, total) for side in (-1, 0, 1))
    survives = F.when((lost > 0) & (total > 0), F.when(delta > 0, low > 0).when(delta < 0, high < 0).otherwise(False))
    # one row beside one row
    both = gates.withColumn("k", F.lit(1)).join(seen.withColumn("k", F.lit(1)), "k")
    return both.select(
        lost.alias("dropped_pairs"), F.round(delta, 6).alias("delta_all_cases"), F.round(low, 6).alias("worst_low"),
        F.round(high, 6).alias("worst_high"), survives.alias("survives"), "eligible",
    )


def verdict(eligible: Column, low: Column, high: Column, survives: Column) -> Column:
    """What the primary difference says: none without eligibility; confirmed only if the dropped pairs cannot turn its sign."""
    firm = F.coalesce(survives, F.lit(True))
    said = F.when(high < 0, "reversed").when((low > 0) & high.isNotNull() & firm, "confirmed").otherwise("inconclusive")
    return F.when(~eligible, "no_confirmatory_verdict").when(low.isNull() | high.isNull(), "inconclusive").otherwise(said)


def primary(scores: DataFrame) -> DataFrame:
    """One row: the missing pairs, the interval of the primary difference and the verdict."""
    of = samples(scored(scores)).where(F.col("metric") == PRIMARY)
    one = F.lit(1)
    held = missingness(scores).withColumn("k", one).join(difference_intervals(of).drop("metric").withColumn("k", one), "k", "left").drop("k")
    return held.withColumn("verdict", verdict(F.col("eligible"), F.col("ci_low"), F.col("ci_high"), F.col("survives")))
