"""Literal rows: text forms, snippets, and the section model."""

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import search, sections, versions

BODY = """# Lov om lys
## Kapittel 1. Åpning
### § 1. Formål
Loven gjelder.
### § 2 a. Lys
Første.
### Takster fra 1. juli
En tabell.
### ***
## Vedlegg
### § 1. Igjen
Annen."""


def one(spark, column, *values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(column(F.col("v"))).collect()]


def test_slugs_keep_letters_and_fit_their_bytes(spark):
    long = "ø" * 90 + " " + "å" * 90
    assert one(spark, text.slug, "Årsregnskap & Co.", long, "ø" * 150) == ["årsregnskap-co", "ø" * 90, "ø" * 100]
    assert one(spark, text.block_id, "Takster fra 1. juli", "***", "x" * 59 + " y") == ["#takster-fra-1-juli", "", "#" + "x" * 59]


def test_quotes_fold(spark):
    assert one(spark, text.quote_folded, "Ord[^1] og «A»\u201b \u00a0 B\u2014C", "[^ 1]") == ["ord og «a»' b-c", "[^ 1]"]


def test_identity_numbers_need_a_date(spark):
    weights = ((3, 7, 6, 1, 8, 9, 4, 5, 2), (5, 4, 3, 2, 7, 6, 5, 4, 3, 2))

    def whole(start):
        for serial in range(1000):
            digits = [int(c) for c in f"{start}{serial:03d}"]
            for row in weights:
                digits.append(-sum(d * w for d, w in zip(digits, row)) % 11)
            if max(digits) < 10:
                return "".join(map(str, digits))

    good, bad = [whole(s) for s in ("010190", "410190", "014190", "018190")], [whole(s) for s in ("000190", "320190", "011390")]
    assert one(spark, text.identity_number, *good, *bad, "123") == [True] * 4 + [False] * 4


def test_snippets_where_lower_case_is_longer(spark):
    held = "\u0130" * 60 + " TION after"
    docs = spark.createDataFrame([(1, held)], "doc_id long, text string")
    row = search.body_search(docs, "tion").first()
    assert row.match_count == 1 and "TION after" in row.snippet


def test_sections_requests_and_differences(spark):
    docs = spark.createDataFrame([("a", BODY)], "doc_id string, text string")
    found = sections.sections(docs).orderBy("pos").collect()
    assert [(r.section_id, r.heading, r.parent_chapter, r.layer, r.kind, r.body, r.occurrence) for r in found] == [
        ("1", "Formål", "Kapittel 1. Åpning", "main", "section", "Loven gjelder.", 1),
        ("2a", "Lys", "Kapittel 1. Åpning", "main", "section", "Første.", 1),
        ("#takster-fra-1-juli", "Takster fra 1. juli", "Kapittel 1. Åpning", "main", "block", "En tabell.", 1),
        ("1", "Igjen", "Vedlegg", "vedlegg", "section", "Annen.", 2),
    ]
    asked = spark.createDataFrame([("a", "§ 2 A", None), ("a", "1", None), ("a", "1", 2), ("a", "9", None)], "doc_id string, section_id string, occurrence int")
    got = {(r.section_id, r.occurrence): (r.state, r.body) for r in sections.requested(sections.sections(docs), asked).collect()}
    assert got == {("2a", None): ("found", "Første."), ("1", None): ("ambiguous", None), ("1", 2): ("found", "Annen."), ("9", None): ("missing", None)}
    after = spark.createDataFrame([("a", BODY.replace("Første.", "Andre.").replace("### § 1. Formål\nLoven gjelder.\n", "") + "\n### § 3.\nNy.")], "doc_id string, text string")
    diff = {(r.section_id, r.change_type): (r.body_before, r.body_after) for r in sections.section_diff(sections.sections(docs), sections.sections(after)).collect()}
    assert diff == {("2a", "changed"): ("Første.", "Andre."), ("1", "removed"): ("Loven gjelder.", None), ("3", "added"): (None, "Ny.")}


def test_revisions_are_appended_without_gaps(spark):
    held = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x"), ("c", 3, "y")], "k string, rev long, substance string")
    fresh = spark.createDataFrame([("a", "y"), ("b", "z"), ("d", "x")], "k string, substance string")
    got = {(r.k, r.rev, r.substance) for r in versions.appended(held, fresh, "k", "substance").collect()}
    assert got == {("b", 2, "z"), ("d", 1, "x")}
    assert [r.k for r in versions.revision_gaps(held, "k").collect()] == ["c"]
