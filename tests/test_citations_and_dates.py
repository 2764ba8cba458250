"""Literal rows: citations within reach, dates, and audits; a plain version of the citation rule on random texts."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from folioscope.operators import audit, citations, workdays

ACTS = {"annen-lov", "lov", "skatteloven", "skatteloven-sktl", "own"}


def plainly(text, own):
    """First wording and count by (act, section), read off the text with its positions."""
    low, out = text.lower(), {}
    refs = list(re.finditer(r"§\s*(\d+(?:-[\da-z]+)?)", text))
    ends, starts = [0] + [r.end() for r in refs], [r.start() for r in refs] + [len(text)]

    def words(a, b):
        return [(m.start() + a, m.group()) for m in re.finditer("[a-z0-9æøåäöü-]+", low[a:b])]

    for k, ref in enumerate(refs):
        stop = starts[k + 1]
        if k + 1 < len(refs):
            for at, word in words(ref.end(), stop):
                if word in ACTS and not low[at + len(word) : stop].strip():
                    stop = at
        near = words(max(ends[k], ref.start() - 80), ref.start()) + words(ref.end(), min(stop, ref.end() + 80))
        others = [w for _, w in near if w in ACTS and w != own]
        key = (max(others, key=len) if others else own, ref.group(1))
        first, n = out.get(key, (ref.group(), 0))
        out[key] = (first, n + 1)
    return out


def test_references_equal_a_plain_reading(spark):
    draw = random.Random(7)
    bits = ["§ 5-13", "§9", "§  2a", "§ ", "Annen-Lov", "lov", "skatteloven", "skatteloven-sktl", "samt", ". ", ", ", " ", " i ", "own", "ø" * 30, "x" * 75, "x" * 70 + " "]
    texts = {k: "".join(draw.choice(bits) + draw.choice(["", " "]) for _ in range(draw.randrange(40))) for k in range(150)}
    texts |= {900: "Gjelder § 2-7. Unntatt annen-lov § 4-1.", 901: "Gjelder § 2-7. Unntak finnes ved § 4-1 i annen-lov"}
    rows = spark.createDataFrame([(k, "own", t) for k, t in texts.items()] + [(901_000, "own", None)], "key long, slug string, text string")
    acts = spark.createDataFrame([(a,) for a in sorted(ACTS)], "slug string")
    got = {}
    for r in citations.references(rows, acts).collect():
        got.setdefault(r.key, {})[(r.target, r.section_id)] = (r.wording, r.n)
    assert got == {k: said for k, t in texts.items() if (said := plainly(t, "own"))}
    assert set(got[900]) == {("own", "2-7"), ("annen-lov", "4-1")} == set(got[901])


def test_texts_are_read_once(spark):
    """texts were made and cut thrice, for common words, for the meeting with the acts and for the references."""
    draw = random.Random(11)
    bits = ["§ 1", "§ 2-a", " § 3", "lov", "Lov ", "annen-lov \t", "skatteloven-sktl", "own ", "x" * 79 + " ", "y" * 200, " lov\n", ".", "ÆØÅ-", "\x0b", " " * 82, "se "]
    texts = {k: "".join(draw.choice(bits) for _ in range(draw.randrange(30))) for k in range(200)}
    # an act that begins within reach and ends beyond it, and one in two halves
    texts |= {800: "§ 1 " + "z" * 74 + " skatteloven § 2", 801: "§ 1 " + "z" * 75 + " lov " + "z" * 76 + " lov§ 2", 802: "§ 1 " + " " * 90 + "lov § 2"}
    rows = spark.createDataFrame([(k, "own", t) for k, t in texts.items()], "key long, slug string, text string")
    told = citations.references(rows, spark.createDataFrame([(a,) for a in sorted(ACTS)], "slug string"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and plan.count("mentions-") == 2
    got = {}
    for r in told.collect():
        got.setdefault(r.key, {})[(r.target, r.section_id)] = (r.wording, r.n)
    assert got == {k: said for k, t in texts.items() if (said := plainly(t, "own"))}


def test_verdicts_have_three_values(spark):
    refs = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "2"), ("c", "1")], "target string, section_id string")
    acts = spark.createDataFrame([("a", True), ("b", False)], "slug string, complete boolean")
    there = spark.createDataFrame([("a", "1"), ("c", "1")], "slug string, section_id string")
    got = {(r.target, r.section_id): r.valid for r in citations.verdicts(refs, acts, there).collect()}
    assert got == {("a", "1"): True, ("a", "2"): False, ("b", "2"): None, ("c", "1"): False}


def test_easter_of_known_years(spark):
    known = ["1961-04-02", "1981-04-19", "1954-04-18", "2000-04-23", "2008-03-23", "2011-04-24", "2025-04-20", "2026-04-05", "2038-04-25", "2049-04-18", "2076-04-19"]
    rows = spark.createDataFrame([(d,) for d in known], "d string")
    got = rows.select("d", workdays.easter(F.substring("d", 1, 4)).cast("string").alias("e")).collect()
    assert [r.e for r in got] == [r.d for r in got]


def test_working_days(spark):
    day = dt.date.fromisoformat
    asked = [(day("2025-04-16"), 1, "2025-04-22"), (day("2025-12-24"), 1, "2025-12-29"), (day("2025-05-16"), 2, "2025-05-20"), (day("2025-06-07"), 0, "2025-06-07"), (None, 3, None), (day("2025-06-07"), None, None)]
    rows = spark.createDataFrame([(k, s, n) for k, (s, n, _) in enumerate(asked)], "k int, sent date, n int")
    got = workdays.with_working_day(rows, "sent", "n").orderBy("k").select(F.col("due").cast("string")).collect()
    assert [r[0] for r in got] == [due for *_, due in asked]
    assert workdays.with_working_day(rows.limit(0), "sent", "n").count() == 0


def test_language_tags(spark):
    tags = ["nb", "nob", "nb-NO", "sr-Latn-RS", "es-419", "", None, "NB", "norsk", "nb_NO", "nb\n"]
    manifest = spark.createDataFrame([(k, k, "current") for k in range(len(tags))], "doc_id int, path int, status string")
    files = spark.createDataFrame([(k, None, t) for k, t in enumerate(tags)], "path int, declared_id int, language string")
    assert sorted(r.doc_id for r in audit.declared_findings(manifest, files).collect()) == [7, 8, 9, 10]
