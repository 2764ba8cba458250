"""Search over records and bodies, old addresses, corrections and stored vectors, on literals and at random."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import graph, observe, search, vectors

MANIFEST = [
    ("a", "lov-a", "Om skatt", "current", "lover"), ("b", "lov-b", "Om avgift", "current", "lover"), ("c", "lov-c", "Skatt fra før", "removed", "lover"), ("d", None, "Skatt uten navn", "current", "lover"),
    ("e", "to", "Skatt en", "current", "lover"), ("f", "to", "Skatt to", "current", "lover"), ("g", "f-g", None, "current", "forskrifter"), ("h", "f-h", "Tom", "current", "forskrifter"),
]
BODIES = [
    ("a", "x" * 80 + " Skatt\nav inntekt og SKATT. " + "y" * 80), ("b", "Linje\n| en |  skatt[^1] av | to |\n| tre |"), ("c", "skatt"), ("d", "skatt"), ("e", "skatt"), ("f", "skatt"),
    ("g", "İİ ska[^12]tt av, [^ ikke et merke] skatt"), ("h", None),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(MANIFEST, "doc_id string, slug string, title string, status string, dataset string"), spark.createDataFrame(BODIES, "doc_id string, text string")


def test_text_search(corpus):
    manifest, bodies = corpus
    got = [tuple(r) for r in search.text_search(manifest, bodies, "sKatt").collect()]
    assert [(r[0], r[1], r[4]) for r in got] == [("f-g", "g", 2), ("lov-a", "a", 2), ("lov-b", "b", 1)]
    assert got[0][2:4] == (None, "forskrifter") and got[0][5] == "İİ ska[^12]tt av, [^ ikke et merke] skatt"
    assert got[1][5] == "..." + "x" * 49 + " Skatt av inntekt og SKATT. " + "y" * 28 + "..."
    assert got[2][5] == "| en | skatt[^1] av | to |"
    assert [r.slug for r in search.text_search(manifest, bodies, "skatt av").collect()] == ["f-g", "lov-b"]  # the marker is no part of the words
    assert [r.slug for r in search.text_search(manifest, bodies, "skatt", "lover", 1).collect()] == ["lov-a"]
    assert search.text_search(manifest, bodies, " \t").count() == 0 and search.text_search(manifest, bodies, "(").count() == 0


def test_record_search(corpus):
    manifest, _ = corpus
    assert [r.doc_id for r in search.record_search(manifest, "SKATT").collect()] == ["a", "d", "e", "f"]
    assert [r.doc_id for r in search.record_search(manifest, "a om").collect()] == ["a"]  # slug and title together
    assert [r.doc_id for r in search.record_search(manifest, "f", "forskrifter").collect()] == ["g", "h"]
    assert search.record_search(manifest, "").count() == 0


def test_old_addresses(spark):
    rows = [
        ("a", "b", 1), ("b", "c", 2), ("live", "x", 1), ("d", None, 1), ("e", "d", 3), ("f", "g", 1), ("g", "f", 2), ("h", "f", 3), ("i", "nowhere", 1), ("j", "a", 1), ("j", None, 2), ("k", None, 1), ("k", "b", 2),
    ]
    live = spark.createDataFrame([("c",), ("live",)], "address string")
    got = {r.address: (r.target, r.outcome) for r in graph.redirects(spark.createDataFrame(rows, "old string, new string, at int"), live).collect()}
    assert got == {
        "a": ("c", "moved"), "b": ("c", "moved"), "d": (None, "gone"), "e": (None, "gone"), "f": (None, "cyclic"), "g": (None, "cyclic"), "h": (None, "cyclic"), "i": (None, "gone"), "j": (None, "gone"),
        "k": ("c", "moved"),
    }


def test_corrections_into_a_cycle_are_not_in_force(spark):
    records = spark.createDataFrame([(k,) for k in range(6)], "record_id long")
    fixes = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 5)], "retracts long, replaced_by long")
    assert {r.record_id: r.in_force for r in observe.corrected(records, fixes).collect()} == {0: 0, 1: None, 2: None, 3: None, 4: 5, 5: 5}


@pytest.mark.parametrize("seed", range(4))
def test_incremental_vectors_equal_a_full_pass(spark, seed):
    rng = random.Random(seed)
    store, now = [], []
    for d in range(30):
        held = {t: [rng.uniform(-1, 1) * rng.choice([1, 1, 3]) for _ in range(4)] for t in range(rng.randrange(1, 8))}
        if rng.random() < 0.1:
            held = {t: [0.0] * 4 for t in held}
        store += [(d, t, v) for t, v in held.items() if rng.random() < 0.7]
        now += [(d, t, v) for t, v in held.items() if rng.random() < 0.8]
    of = "document long, text long, vector array<double>"
    prior = vectors.quantised_together(spark.createDataFrame(store, of), "document").select("document", "text", "row", "scale")
    inputs = spark.createDataFrame(now, of)
    full = {(r.document, r.text): (r.row, r.scale) for r in vectors.quantised_together(inputs, "document").collect()}
    got = vectors.incremental(inputs, prior).collect()
    assert {(r.document, r.text): (r.row, r.scale) for r in got} == full
    assert {r.how for r in got} == {"reused", "fresh", "redone"}
    stored = {(d, t) for d, t, _ in store}
    assert {(r.document, r.text) for r in vectors.paid(inputs, prior).collect()} == {(d, t) for d, t, _ in now} - stored
    assert all((r.document, r.text) in stored for r in got if r.how == "reused")
    assert vectors.incremental(inputs.where(F.lit(False)), prior).count() == 0
