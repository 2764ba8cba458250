"""Quality rules as a short-circuit cascade.

Every rule is a column expression. A sample gives each rule's share of
rejections and its cost in seconds; the rules are then tried in the order of
rejections per cost, in one CASE expression that Spark evaluates lazily, so a
document that a cheap rule rejects never pays for a dear one. The order changes
no verdict, since a document is kept only where no rule rejects it.

Defined results: a null or empty text has no words and is rejected; rows that
repeat get the same verdict; columns of any name are kept as they are; very long
texts are judged whole; an empty table gives no rows and the given order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, own_row, text_or_empty, words_of

SYMBOLS = r"[#*$%&|<>]"
BLANK = r"[\x20\x09-\x0D]"
UPPER = "[A-Z]"
#: Costs below this are taken as equal: a clock tells no less.
LEAST_SECONDS = 1e-3
#: Names that the operator adds while it works.
TEXT, WORDS, COUNT = "__q_text", "__q_words", "__q_n"


def n_chars_in(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(characters)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(text).cast("long") - n_chars_in(text, BLANK)


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(WORD)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, even where Spark moves the expression into a filter or a lambda."""
    return F.transform(F.array(value), use)[0]


def n_dup_lines(text: Column) -> Column:
    return bound(filled_lines(text), lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words in 3-word windows found twice or more.

    A window is one long: the top bits of its hash, then its position. Sorted,
    windows of equal hash bits stand side by side; the words themselves are then
    compared, so a shared hash alone counts for nothing. Where a neighbour shares
    the bits but not the words, the window is looked for among all that share them.
    """

    def counted(words: Column, bits: Column, mask: Column) -> Column:
        def packed(i: Column) -> Column:
            h = F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
            return F.call_function("shiftleft", h, bits).bitwiseOR(i)

        def at(key: Column) -> Column:
            return key.bitwiseAND(mask).cast("int")

        def same_words(p: Column, q: Column) -> Column:
            return F.slice(words, p + 1, 3) == F.slice(words, q + 1, 3)

        def alike(a: Column, b: Column) -> Column:
            return a.bitwiseXOR(b).between(0, mask)

        def same(a: Column, b: Column) -> Column:
            return alike(a, b) & same_words(at(a), at(b))

        def starts(keys: Column) -> Column:
            def is_twice(k: Column, i: Column) -> Column:
                # beside the first and the last key stands null, which equals nothing
                before, after = F.get(keys, i - 1), F.get(keys, i + 1)
                further = F.exists(keys, lambda q: (q != k) & same(k, q))
                near = alike(k, before) | alike(k, after)
                return F.when(near, F.when(same(k, before) | same(k, after), True).otherwise(further)).otherwise(False)

            return F.sort_array(F.transform(F.filter(keys, is_twice), at))

        def covered(places: Column) -> Column:
            steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))

        keys = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: packed(i)))
        return bound(bound(keys, starts), covered)

    def shifted(words: Column) -> Column:
        width = F.length(F.bin(F.size(words)))
        one = F.lit(1).cast("long")
        return bound(width, lambda bits: bound(F.call_function("shiftleft", one, bits) - 1, lambda mask: counted(words, bits, mask)))

    return bound(words, lambda w: F.when(F.size(w) >= 3, shifted(w)).otherwise(F.lit(0).cast("long")))


@dataclass(frozen=True)
class Rule:
    """Rejects where ``test`` holds; ``test`` is over TEXT, WORDS and COUNT."""

    name: str
    test: Column


def features() -> dict[str, Column]:
    """What the rules are stated over; each is computed only where it is asked for."""
    text, words = F.col(TEXT), F.col(WORDS)
    return {
        "n_words": F.col(COUNT),
        "word_chars": word_chars(text),
        "n_symbols": n_chars_in(text, SYMBOLS),
        "n_upper": n_chars_in(text, UPPER),
        "n_lines": F.size(filled_lines(text)),
        "n_dup_lines": n_dup_lines(text),
        "n_repeat_words": n_repeat_words(words),
    }


def base_rules(known: dict[str, Column] | None = None) -> list[Rule]:
    f = features() | (known or {})
    return [Rule("few_words", f["n_words"] < 50), Rule("repeated_windows", f["n_repeat_words"] * 100 > f["n_words"] * 50)]


def more_rules(known: dict[str, Column] | None = None) -> list[Rule]:
    """``known``: columns that hold features already."""
    f = features() | (known or {})
    return [
        Rule("symbols", f["n_symbols"] * 100 > f["n_words"] * 20),
        Rule("shouting", f["n_upper"] * 100 > f["word_chars"] * 50),
        Rule("repeated_lines", f["n_dup_lines"] * 100 > f["n_lines"] * 50),
        Rule("odd_words", ~f["word_chars"].between(f["n_words"] * 2, f["n_words"] * 20)),
    ]


def standard_rules() -> list[Rule]:
    return base_rules() + more_rules()


def prepared(docs: DataFrame, text: str = "text") -> DataFrame:
    ready = docs.withColumn(TEXT, text_or_empty(text)).withColumn(WORDS, words_of(F.col(TEXT)))
    return ready.withColumn(COUNT, F.size(WORDS).cast("long"))


def measured(docs: DataFrame, rules: list[Rule], sample_rows: int = 2000, seed: int = 11) -> list[tuple[Rule, float, float]]:
    """Each rule with its share of rejections and seconds on a sample of about ``sample_rows`` rows.

    Only the order of the rules depends on the sample, never a verdict.
    """
    total = docs.count()
    if not total:
        return [(rule, 0.0, 1.0) for rule in rules]
    sample = prepared(docs.select("text").sample(min(1.0, sample_rows / total), seed)).persist()

    def timed(test: Column) -> tuple[int, float]:
        """Hits, and the seconds of a second run: the first also compiles."""
        job = sample.agg(F.count_if(test))
        job.first()
        began = time.perf_counter()
        hits = job.first()[0]
        return hits, time.perf_counter() - began

    try:
        rows = max(1, sample.count())
        _, idle = timed(F.lit(False))  # what a job costs that tests nothing
        figures = [(rule, *timed(rule.test)) for rule in rules]
        return [(rule, hits / rows, max(took - idle, LEAST_SECONDS)) for rule, hits, took in figures]
    finally:
        sample.unpersist()


def ordered(figures: list[tuple[Rule, float, float]]) -> list[Rule]:
    """By rejections per second, most first; ties by name."""
    return [f[0] for f in sorted(figures, key=lambda f: (-f[1] / max(f[2], LEAST_SECONDS), f[0].name))]


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, or null."""
    out = None
    for rule in rules:
        out = F.when(rule.test, F.lit(rule.name)) if out is None else out.when(rule.test, F.lit(rule.name))
    return F.lit(None).cast("string") if out is None else out


def judged(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """Each row of ``docs``, as the struct ``row``, with ``rejected`` (boolean).

    Which rule names a rejection depends on the order, so only the verdict is given.
    """
    rules = ordered(measured(docs, rules or standard_rules(), sample_rows))
    rows = prepared(docs.select(own_row(docs), text_or_empty().alias("text")))
    return rows.select("row", cascade(rules).isNotNull().alias("rejected"))


def keep_good(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The documents no rule rejects, with their own columns."""
    return judged(docs, rules).where("NOT rejected").select("row.*")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    order = [r.name for r in ordered(measured(docs, more_rules()))]
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    have = features()
    counted = prepared(docs).select("doc_id", TEXT, *(have[c].alias(c) for c in shown))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    by_name = {r.name: r for r in more_rules({c: F.col(c) for c in shown})}
    # the base verdict is at hand, so it is tried first
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade([by_name[n] for n in order]).isNull())
    return counted.withColumn("base_failed", failed).withColumn("kept", kept).drop(TEXT)


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, w, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), rep AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1
), cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN ln USING (doc_id) LEFT JOIN cov USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
       OR 100 * n_upper > 50 * word_chars OR 100 * n_dup_lines > 50 * n_lines
       OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words) AS kept
FROM m
"""
