"""Citations in free text held against acts and sections."""

import pytest

from folioscope.operators import citations

ACTS = ["skatteloven-sktl", "skatteloven", "ferieloven-fl", "avtaleloven-avtl", "arveloven-al", "arveloven-ny", "taalov-tvist", "taalov-tvist", "høyloven-høyl"]
SECTIONS = [
    ("skatteloven-sktl", "5-12", "Inntekt"), ("skatteloven-sktl", "33i", "Tillegg"), ("skatteloven-sktl", "7", "Første"), ("skatteloven-sktl", "7", "Andre"),
    ("avtaleloven-avtl", "36", "Urimelig"), ("skatteloven", "12", "Gammel"), ("høyloven-høyl", "2a", "Høy"),
]
CASES = [
    ("§ 5-12 skatteloven-sktl", (True, "skatteloven-sktl", "5-12", "Inntekt", None)),
    ("Skatteloven-sktl § 33 i.", (True, "skatteloven-sktl", "33i", "Tillegg", None)),
    ("§ 5-12 i skatteloven-sktl", (True, "skatteloven-sktl", "5-12", "Inntekt", None)),
    ("skatteloven § 12 og skatteloven-sktl", (False, "skatteloven-sktl", "12", None, "no_section")),
    ("skatteloven § 12", (True, "skatteloven", "12", "Gammel", None)),
    ("§ 7 skatteloven-sktl", (False, "skatteloven-sktl", "7", None, "ambiguous_section")),
    ("avtaleloven § 36", (True, "avtaleloven-avtl", "36", "Urimelig", None)),
    ("avtl. § 36", (True, "avtaleloven-avtl", "36", "Urimelig", None)),
    ("avtl § 36", (False, None, "36", None, "no_act")),
    ("fl. § 1", (False, None, "1", None, "no_act")),
    ("arveloven § 1", (False, None, "1", None, "ambiguous_act")),
    ("avtaleloven og ferieloven", (False, None, None, None, "ambiguous_act")),
    ("taalov-tvist § 1", (False, None, "1", None, "claimed_act")),
    ("§§ 1-3 skatteloven", (False, None, None, None, "range")),
    ("HØYLOVEN § 2 a", (True, "høyloven-høyl", "2a", "Høy", None)),
    ("ferieloven", (True, "ferieloven-fl", None, None, None)),
    ("xskatteloven-sktl § 7", (False, None, "7", None, "no_act")),
    ("§", (False, None, None, None, "unparsed")),
    ("", (False, None, None, None, "unparsed")),
    (None, (False, None, None, None, "unparsed")),
]


@pytest.mark.parametrize("empty", [False, True])
def test_verdicts(spark, empty):
    asked = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(CASES)], "key long, citation string")
    acts = spark.createDataFrame([(a,) for a in ACTS], "slug string")
    sections = spark.createDataFrame(SECTIONS, "slug string, section_id string, heading string")
    if empty:
        got = citations.validated(asked, acts.limit(0), sections.limit(0)).collect()
        assert len(got) == len(CASES) and not any(r.valid for r in got)
        return
    got = {r.key: (r.valid, r.slug, r.section_id, r.heading, r.reason) for r in citations.validated(asked, acts, sections).collect()}
    assert {CASES[k][0]: v for k, v in got.items()} == dict(CASES)
