"""The whole pipeline against a plain version, with odd rows."""

import random
import re

import corpus_pipeline
from llm import brute
from llm.test_operators import prose

from folioscope.llm import bpe, mixing, quality_rules


def good(text):
    """The standard rules, plainly."""
    held, text = brute.words(text), text or ""
    n, chars = len(held), sum(map(len, brute.words(text)))
    windows = [tuple(held[k : k + 3]) for k in range(n - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    repeated = len({k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)})
    lines = [line for line in text.split("\n") if brute.words(line)]
    return not (
        n < 50
        or 100 * repeated > 50 * n
        or 100 * len(re.findall("[#*$%&|<>]", text)) > 20 * n
        or 100 * len(re.findall("[A-Z]", text)) > 50 * chars
        or 100 * (len(lines) - len(set(lines))) > 50 * len(lines)
        or not 2 * n <= chars <= 20 * n
    )


def test_pipeline(spark, tmp_path):
    rng = random.Random(31)
    copy = prose(rng, 120)
    rows = [(k, prose(rng, rng.randrange(30, 200)), f"s{k % 3}") for k in range(60)]
    rows += [(100 + k, copy, "s0") for k in range(20)] + [(200 + k, copy.replace(" ", "  ", 1) if k % 2 else copy + " end", None) for k in range(6)]
    rows += [(300, None, "s1"), (301, "", "s1"), (302, "a b " * 60, "s1"), (303, prose(rng, 90).upper(), "s1"), (304, "### " + "# $ % x " * 20, "s2")]
    twice = rows[:20] + [(100, copy, "s0")] * 30  # rows that repeat id and text are one document
    df = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows + twice], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    kept = [r for r in rows if good(r[1])]
    assert 20 < len(kept) < len(rows)
    first = {}
    for d, t, _ in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), d)
    kept = [r for r in kept if r[0] in first.values()]
    prints = {d: brute.fingerprint(t) for d, t, _ in kept}
    groups = brute.groups(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    kept = [r for r in kept if groups[r[0]] == r[0]]
    planned = {r["doc_id"]: r["copies"] for r in mixing.plan(spark.createDataFrame(kept, "doc_id long, text string, source string")).collect()}
    made = bpe.tokenizer(bpe.default_path())
    want = sorted((d, made.ids(t)) for d, t, _ in kept for _ in range(planned[d]))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == want
    total = sum(len(brute.words(t)) for _, t, _ in kept)
    taken = sum(len(brute.words(t)) * planned[d] for d, t, _ in kept)
    assert 0 <= 1.5 * total - taken <= 2 * 200
    assert [r.name for r in quality_rules.standard_rules()][:2] == ["few_words", "repeated_windows"]


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    """Odd rows and an empty table go through; all but the last stage return the columns they got."""
    names = "doc_id long, text string, lang string, source string, n_chars long, key int, digest string, `row` string"
    text = prose(random.Random(1), 80)
    rows = [(None, text, None, None, None, 1, "x", "y"), (1, text, "en", "a", 1, 1, "x", "y"), (1, text, "en", "a", 1, 1, "x", "y"), (2, None, None, None, None, None, None, None)]
    for held in (rows, []):
        docs = spark.createDataFrame(held, names)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.columns == [n.split()[0].strip("`") for n in names.split(", ")], name
        assert [r.doc_id for r in docs.collect()].count(1) <= mixing.MOST and {r.doc_id for r in docs.collect()} <= {1}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()
