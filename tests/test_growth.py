"""What keeps large tables within their limits: plans without a second shuffle, and the rows that pass between tasks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import citations, events, graph, names, quality, sections, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_notes_are_read_within_their_row(spark):
    """lines and pieces were sorted and shuffled."""
    docs = spark.createDataFrame([(1, "### § 1. A\n> Endret ved lov 1 mai 1999 nr. 1 (ikr. (a) 1 juni 2000), 2 mai 2001 nr. 3 (se b) (ikr. nå.")], "key long, text string")
    found = events.events(docs)
    assert "Exchange" not in plan(found) and "Sort" not in plan(found)
    # the last bracket is left open, so it is no marker
    assert sorted((r.act_no, r.raw_marker) for r in found.collect()) == [(1, "(ikr. (a) 1 juni 2000)"), (2, "(se b)")]


def test_sections_are_cut_within_their_row_and_shuffled_once(spark):
    """lines were sorted and shuffled, sections were built twice for requests and joined four times for differences."""
    # 'b' has one text three times before and twice after
    docs = spark.createDataFrame([("a", "### § 1. A\nx\n## Kap\n### § 1. B\ny"), ("b", "### § 1.\nx\n### § 1.\nx\n### § 1.\nx")], "doc_id string, text string")
    after = spark.createDataFrame([("a", "### § 1. A\ny\n### § 2. C\nx"), ("b", "### § 1.\nx\n### § 1.\nz\n### § 1.\nx")], "doc_id string, text string")
    found = sections.sections(docs)
    assert "Exchange" not in plan(found) and "Sort" not in plan(found)
    asked = spark.createDataFrame([("a", "1", 3), ("a", "1", 2), ("b", "1", None), ("c", "1", None)], "doc_id string, section_id string, occurrence int")
    got = {(r.doc_id, r.occurrence): (r.state, r.n_same, r.heading, r.body) for r in sections.requested(found, asked).collect()}
    assert got == {("a", 3): ("missing", 2, None, None), ("a", 2): ("found", 2, "B", "y"), ("b", None): ("ambiguous", 3, None, None), ("c", None): ("missing", None, None, None)}
    assert plan(sections.requested(found, asked)).count("Generate") == 1
    diff = sections.section_diff(found, sections.sections(after))
    assert plan(diff).count("Generate") == 2
    got = sorted((r.doc_id, r.section_id, r.place, r.body_before, r.body_after, r.change_type) for r in diff.collect())
    assert got == [("a", "1", 1, "x", None, "removed"), ("a", "2", 1, None, "x", "added"), ("b", "1", 1, "x", "z", "changed")]


@pytest.mark.parametrize("slot", [7, 8192])
def test_neighbours_are_found_by_blocks(spark, monkeypatch, slot):
    """every pair was a row. Copies tie, so the least ids stay; zero vectors take no part."""
    monkeypatch.setattr(vectors, "SLOT", slot)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    rows = [(k, [float((k // 3 * 7) % 5 - 2), float(k // 3 % 4), 1.0] if k != 9 else [0.0] * 3, k % 4) for k in range(60)]
    held = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    asked = held.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    found = vectors.neighbours(asked, held, 4)
    assert "Join" not in plan(found)

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)

    for q, vector, label in rows[::10]:
        best = sorted((-cosine(vector, w), k, m == label) for k, w, m in rows if k not in (q, 9))[:4]
        got = sorted((r["rank"], -r.score, r.vec_id, r.hit) for r in found.where(F.col("query_id") == q).collect())
        assert [(s, k, h) for _, s, k, h in got] == best


def test_names_that_no_text_can_have_are_not_matched(spark):
    """all names were matched, in lots of 32 MB each."""
    texts = spark.createDataFrame([(1, "Se SKATTELOVEN § 2 nr-7, og İlov"), (2, None)], "key long, text string")
    held = ["skatteloven", "skatteloven § 2", "skatt", "skatteloven § 3", "§ 2", "(x)", "(", "nr", "nr-7", "og", "customer 2"]
    known = spark.createDataFrame([(n,) for n in held], "name string")
    assert {r["name"] for r in names.possible(known, texts).collect()} == {"skatteloven", "skatteloven § 2", "§ 2", "(", "nr-7", "og"}
    assert names.LOT_BYTES <= 4 << 20
    # what is left fits into one lot, so the matches are not brought together
    assert sorted((r.start, r["name"]) for r in names.scan(texts, known, lot_bytes=60).collect()) == [(3, "skatteloven § 2"), (19, "nr-7"), (25, "og")]


def test_cycles_do_not_add_rounds(spark, monkeypatch):
    """a cycle went round until its steps were more than all edges."""
    written, keep = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(1) or keep(df))
    chains = [(c * 100 + k, c * 100 + k + 1) for c in range(1, 60) for k in range(1 + c % 9)]
    rings = [(c * 100 + 90 + k, c * 100 + 90 + (k + 1) % 3) for c in range(1, 60) for k in range(3)] + [(7, 8), (8, 190)]
    got = {r.a: (r.b, r.steps, r.cyclic) for r in graph.chased_all(spark.createDataFrame(chains + rings, "a long, b long")).collect()}
    ends = {a: (a // 100 * 100 + 1 + a // 100 % 9, 1 + a // 100 % 9 - a % 100, False) for a, _ in chains}
    assert got == ends | {a: (None, None, True) for a, _ in rings}
    # chains are 9 long at most, whatever number there is of rings
    assert len(written) <= 6
    assert all(r.cyclic for r in graph.chased_all(spark.createDataFrame(rings, "a long, b long")).collect())


def test_references_are_read_within_their_row(spark):
    """pieces of texts were sorted five times over, joined with the acts and shuffled."""
    long = "x" * 70 + " "
    texts = {1: f"§ 1 {long}lov", 2: f"§ 1 {long}{long}lov § 2", 3: "lov § 1 Annen-Lov \n§ 2 egen § 3 lov.", 4: "egen § 4", 5: "ingen", 6: None, 7: "lov § 1, annen-lov, § 1"}
    rows = spark.createDataFrame([(k, "egen", t) for k, t in texts.items()], "key long, slug string, text string")
    found = citations.mentions(rows, "key")
    assert "Exchange" not in plan(found) and "Sort" not in plan(found) and "Generate" not in plan(found)
    acts = spark.createDataFrame([("lov",), ("annen-lov",), ("egen",), ("lov",)], "slug string")
    want = [(1, "lov", "1", 1), (2, "egen", "1", 1), (2, "lov", "2", 1), (3, "annen-lov", "2", 1), (3, "lov", "1", 1), (3, "lov", "3", 1), (4, "egen", "4", 1), (7, "annen-lov", "1", 2)]
    told = citations.references(rows, acts)
    # words are joined with the acts, and what was found with the texts: windows over pieces are gone
    assert "Window" not in plan(told) and plan(told).count("Join") == 2
    assert sorted((r.key, r.target, r.section_id, r.n) for r in told.collect()) == want


@pytest.mark.parametrize("often", [0, 2, 50])
def test_near_copies_meet_by_prefixes(spark, monkeypatch, often):
    """F7, F8, F9: every shingle was counted and joined, and sets were shuffled whole four times. The order of shingles must not matter."""
    monkeypatch.setattr(quality, "OFTEN", often)
    draw = random.Random(3)
    passage = [f"p{k}" for k in range(40)]  # in half of the texts: its shingles come last
    texts = []
    for k in range(30):
        words = [f"{draw.choice('abcd')}{draw.randrange(400)}" for _ in range(draw.choice([5, 6, 30, 200]))]
        texts += [words + passage] if k % 2 else [words]
        for _ in range(draw.randrange(4)):  # near copies at all distances, and copies
            other = list(texts[-1])
            for _ in range(draw.randrange(len(other) // 20 + 1)):
                other[draw.randrange(len(other))] = "x"
            texts.append(other)
    docs = spark.createDataFrame([(k * 7 % 1009, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    first = {}
    for k, t in enumerate(texts):
        held = frozenset(tuple(t[i : i + 5]) for i in range(len(t) - 4))
        first[held] = min(first.get(held, 1009), k * 7 % 1009)
    want = {(a, b, round(len(s & t) / len(s | t), 6)) for s, a in first.items() for t, b in first.items() if a < b and len(s & t) / len(s | t) >= 0.8}
    found = quality.shingle_pairs(docs)
    assert len(want) > 5 and {tuple(r) for r in found.collect()} == want
    # one shuffle each of classes, and of the sets that may be similar
    assert not any("collect_list" in line or "Window" in line for line in plan(found).splitlines())


def test_prefixes_put_common_shingles_last():
    sets = quality.pa.array([[-9, -4, 1, 3, 5], [2], [-4, 1, 3, 5, 6, 7, 8, 9, 10, 11]])
    values, taken, size, last = quality.prefixed(sets, 0.8, np.array([-4, 1, 3, 5, 99]))
    assert size.tolist() == [2, 1, 3] and values[taken].tolist() == [-9, -4, 2, 6, 7, 8]
    assert last[0] > last[1] == 0 and quality.prefixed(sets[1:], 0.8, np.zeros(0, np.int64))[0].tolist() == values[5:].tolist()


def test_common_words_of_citations_fill_no_task(spark):
    """every "se" met the names in one task; what a citation named was carried and sorted to the end."""
    asked = spark.createDataFrame([(k, f"Se lov{k % 40 * 25} § {k % 3} i") for k in range(1000)] + [(2000 + k, "Grunnloven § 1") for k in range(300)], "key long, citation string")
    acts = spark.createDataFrame([(f"lov{k}-x{k}",) for k in range(0, 1000, 50)] + [("grunnloven-grl",)], "slug string")
    sections = spark.createDataFrame([("grunnloven-grl", "1", "A")] + [(f"lov{k}-x{k}", "2", "B") for k in range(0, 1000, 50)], "slug string, section_id string, heading string")
    told = citations.validated(asked, acts, sections)
    assert any("isin" in line or " IN (" in line or "INSET" in line for line in told._jdf.queryExecution().optimizedPlan().toString().splitlines() if "grunnloven" in line)
    got = {r.key: (r.slug, r.section_id, r.heading, r.reason) for r in told.collect()}
    assert len(got) == 1300 and all(got[2000 + k] == ("grunnloven-grl", "1", "A", None) for k in range(300))
    for k in range(1000):
        number, known = k % 40 * 25, k % 40 % 2 == 0
        want = (f"lov{number}-x{number}", "2", "B", None) if known and k % 3 == 2 else (f"lov{number}-x{number}", str(k % 3), None, "no_section") if known else (None, f"{k % 3}i", None, "no_act")
        assert got[k] == want
