"""Scores of two arms held against plain Python on invented cases."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import scorecard

SCHEMA = (
    "arm string, case_id long, category string, outcome string, passed boolean, criteria map<string,string>, asserted_h1 array<string>, asserted_citations int, "
    "asserted_resolved int, asserted_valid int, quotes_detected int, quotes_checkable int, quotes_verified int, unresolved_claims int, unattached_quotes int, retrieved boolean"
)


def case(arm, k, category="C1", outcome="PASS", h1=(), cited=0, valid=0, criteria=None, retrieved=False):
    passed = {"PASS": True, "FAIL": False}.get(outcome)
    return (arm, k, category, outcome, passed, criteria, list(h1), cited, cited, valid, 0, 0, 0, 0, 0, retrieved)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def test_each_metric_counts_its_own_cases(spark):
    misled, endorsed = {"claimed-attribution-not-asserted": "fail"}, {"false-premise-not-endorsed": "unresolved"}
    rows = [
        case("treatment", 1, "C4", "FAIL", criteria=misled, retrieved=True),
        case("treatment", 2, "C6", "FAIL", criteria=endorsed),
        case("treatment", 3, "C8", "UNRESOLVED_SEMANTIC", h1=["1"], cited=2, valid=1),
        case("treatment", 4, "C2", "PASS", cited=3, valid=3),
        ("treatment", 5, None, "PASS", None, None, None, *[None] * 8, None),
    ]
    got = {r.metric: (r.numerator, r.denominator) for r in scorecard.rates(scorecard.samples(frame(spark, rows))).collect()}
    assert got == {
        "unconditional_h1_rate": (1, 5), "citation_coverage": (2, 5), "citation_hallucination_rate": (1, 2), "citation_accuracy": (4, 5),
        "valid_citations_per_answer": (4, 5), "invalid_citations_per_answer": (1, 5), "misattribution_rate": (1, 1), "correct_provision_identification": (1, 1),
        "quote_fidelity": (0, 0), "false_premise_rejection_rate": (0, 0), "no_invention_rate_resolved_cases": (0, 0), "post_direct_retrieval_hallucination_rate": (1, 1),
    }


def test_errors_drop_pairs_and_unequal_arms_are_refused(spark):
    rows = [case(arm, k, outcome="MODEL_ERROR" if (arm, k) == ("control", 2) else "SCORER_ERROR" if k == 3 else "PASS") for arm in ("control", "treatment") for k in range(5)]
    scores = frame(spark, rows)
    assert {r.case_id for r in scorecard.scored(scores).collect()} == {0, 1, 4}
    assert scorecard.eligibility(scores).first().asDict() == {
        "pairs_total": 5, "pairs_scored": 3, "model_error_pairs": 1, "scorer_error_pairs": 1, "model_gate": True, "scorer_gate": True, "eligible": True}
    with pytest.raises(Exception, match="different cases"):
        scorecard.eligibility(frame(spark, rows[1:])).collect()


def test_intervals_lie_near_a_plain_bootstrap(spark):
    draw = random.Random(7)
    rows = [case(arm, k, h1=["1"] if draw.random() < p else [], cited=1, valid=draw.randrange(2)) for k in range(60) for arm, p in (("control", 0.5), ("treatment", 0.1))]
    scores = frame(spark, rows)
    hit = {(r[0], r[1]): bool(r[6]) for r in rows}
    plain = sorted(sum(hit["control", k] - hit["treatment", k] for k in draw.choices(range(60), k=60)) / 60 for _ in range(4000))
    row = scorecard.primary(scores).first()
    assert abs(row.ci_low - plain[100]) < 0.04 and abs(row.ci_high - plain[3899]) < 0.04
    assert (row.verdict, row.dropped_pairs, row.survives) == ("confirmed", 0, None)
    means = scorecard.mean_intervals(scorecard.samples(scores)).collect()
    assert len(means) == 4 and all(r.ci_low < r.ci_high for r in means)


def test_verdicts(spark):
    table = [(True, 0.1, 0.2, None, "confirmed"), (True, 0.1, 0.2, False, "inconclusive"), (True, -0.2, -0.1, True, "reversed"),
             (True, -0.1, 0.1, True, "inconclusive"), (True, None, None, None, "inconclusive"), (False, 0.1, 0.2, True, "no_confirmatory_verdict")]
    rows = spark.createDataFrame(table, "e boolean, low double, high double, s boolean, want string")
    got = rows.select("want", scorecard.verdict(*map(F.col, ("e", "low", "high", "s"))).alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_an_empty_run_has_no_rates(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert scorecard.rates(scorecard.samples(none)).count() == 0
    row = scorecard.missingness(none).first()
    assert (row.dropped_pairs, row.delta_all_cases, row.survives) == (0, None, None)


def test_direct_retrieval(spark):
    calls = "array<struct<name:string,is_error:boolean,slug:string,section_id:string>>"
    rows = [([("get", None, "act", "§ 2 A.")], True), ([("get", True, "act", "2a")], False), ([("find", False, "act", "2a")], False), ([], False), (None, False)]
    held = spark.createDataFrame(rows, f"calls {calls}, want boolean")
    hit = scorecard.retrieved_directly(F.col("calls"), F.lit("act"), F.lit("2a"), "get")
    assert all(r.want == r.got for r in held.select("want", hit.alias("got")).collect())
