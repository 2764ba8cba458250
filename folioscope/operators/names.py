"""Names of acts: an index of them, their mentions in texts, and what a citation by name refers to."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc_folded
from ..session import written
from . import citations

#: Endings of the short names that titles hold in brackets.
SUFFIXES = ("loven", "lova", "forskriften", "forskrifta")
#: Bytes of names that a task matches at once (their automaton takes many times as much); more names are matched in lots of this size.
LOT_BYTES = 4 << 20
WORDS = re.compile(r"[\w-]+")


def index(acts: DataFrame) -> DataFrame:
    """key, slug, status: every name of acts (slug, title, status).

    An act is named by its slug, by its title, and by the short name that its
    title holds in brackets: one word with an ending that such names have. Names are
    folded (NFKC, case, white space); acts without a slug have none.
    """
    bracketed = F.transform(F.regexp_extract_all("title", F.lit(r"\(([^()]+)\)"), F.lit(1)), lambda n: F.struct(n.alias("name"), F.lit(True).alias("short")))
    whole = F.array(*(F.struct(F.col(c).alias("name"), F.lit(False).alias("short")) for c in ("slug", "title")))
    rows = acts.where("slug IS NOT NULL").select("slug", "status", F.inline(F.concat(whole, F.coalesce(bracketed, F.array().cast(T.ArrayType(whole_type()))))))
    told = rows.where("name IS NOT NULL").select(nfkc_folded("name").alias("key"), "slug", "status", "short")
    fits = ~F.col("short") | (~F.contains("key", F.lit(" ")) & F.col("key").rlike(f"({'|'.join(SUFFIXES)})$"))
    return told.where(fits & (F.col("key") != "")).select("key", "slug", "status").distinct()


def whole_type() -> T.StructType:
    return T.StructType([T.StructField("name", T.StringType()), T.StructField("short", T.BooleanType(), False)])


def _unit(c: str) -> bool:
    return c.isalnum() or c in "_-"


def _lowered(text: str) -> str:
    held = text.lower()
    return held if len(held) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=1)
def _automaton(names: tuple[str, ...]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for name in names:
        made.add_word(name)
    made.make_automaton()
    return made


def candidates(text: str, automaton: ahocorasick.Automaton) -> dict[int, int]:
    """Where a name begins, and the end of the longest one that begins there; a letter, digit, low line or hyphen at either side is part of another word."""
    held, out = _lowered(text), {}
    for last, size in automaton.iter(held):
        start, end = last + 1 - size, last + 1
        if (start and _unit(held[start - 1])) or (end < len(held) and _unit(held[end])):
            continue
        if out.get(start, 0) < end:
            out[start] = end
    return out


def leftmost(found: dict[int, int]) -> Iterator[tuple[int, int]]:
    """From left to right those that do not overlap one taken before."""
    at = 0
    for start in sorted(found):
        if start >= at:
            at = found[start]
            yield start, at


def _found(texts: DataFrame, names: list[str], key: str, resolved: bool) -> DataFrame:
    """Matches of one lot of names; if ``resolved``, without overlaps."""
    held = texts.sparkSession.sparkContext.broadcast(tuple(sorted(names)))
    fields = [texts.schema[key], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _automaton(held.value) if held.value else None
        for batch in batches:
            of, starts, ends, said = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                found = candidates(text, made) if text and made else {}
                for start, end in leftmost(found) if resolved else found.items():
                    of.append(row)
                    starts.append(start)
                    ends.append(end)
                    said.append(_lowered(text[start:end]))
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(said, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return texts.select(key, F.col("text").cast("string")).mapInArrow(run, T.StructType(fields))


def _words(rows: DataFrame, column: str, *kept: str) -> DataFrame:
    """The words of ``column`` as ``_unit`` tells them, with the ``kept`` columns; each once a batch."""
    fields = [*(rows.schema[c] for c in kept), T.StructField("word", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *held, texts = (c.to_pylist() for c in batch.columns)
            met = {(*of, word) for *of, text in zip(*held, texts) if text for word in WORDS.findall(_lowered(text))}
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in met], t) for k, t in enumerate([*(batch.schema.field(k).type for k in range(len(kept))), pa.string()])], names=[f.name for f in fields])

    return rows.select(*kept, F.col(column).cast("string")).mapInArrow(run, T.StructType(fields))


def possible(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``names`` (name, each once) whose words all occur in texts: a mention begins and ends at words, so no other name can have one."""
    there = _words(texts, "text").distinct()
    told = written(names.select("name", F.col("name").alias("said")), "names")
    lacking = _words(told, "said", "name").join(there, "word", "left_anti").select("name").distinct()
    return written(told.select("name").join(lacking, "name", "left_anti"), "names")


def scan(texts: DataFrame, names: DataFrame, key: str = "key", lot_bytes: int = LOT_BYTES) -> DataFrame:
    """Every mention of ``names`` (name, folded) in texts (key, text): key, start, end (exclusive) and name; leftmost first, the longest of those, none overlapping.

    Texts are read once, and not shuffled, while the names fit into one lot, whose
    size is looked at before it is sent. Of more names only those whose words
    the texts have are looked for, in lots of that size;
    then the lots' matches alone are brought together by text. The key tells texts apart.
    Null and empty texts and names have no mentions.
    """
    told = names.where("name != ''").select("name").distinct()
    size = told.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    if size > lot_bytes:
        told = possible(told, texts)
        size = told.agg(F.sum(F.octet_length("name"))).first()[0] or 0
    lots = max(1, -(-size // lot_bytes))
    if lots == 1:
        return _found(texts, [r["name"] for r in told.collect()], key, True)
    parts = [_found(texts, [r["name"] for r in told.where(F.pmod(F.xxhash64("name"), F.lit(lots)) == k).toLocalIterator()], key, False) for k in range(lots)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    longest = every.groupBy(key, "start").agg(F.max_by("name", "end").alias("name"), F.max("end").alias("end"))
    # only mentions that hang together by overlaps must be gone through one by one
    line = Window.partitionBy(key).orderBy("start")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    marked = longest.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
    chains = marked.withColumn("chain", F.sum("fresh").over(line)).groupBy(key, "chain").agg(F.array_sort(F.collect_list(F.struct("start", "end", "name"))).alias("all"))
    none = F.slice("all", 1, 0)
    kept = F.aggregate("all", none, lambda out, m: F.when((F.size(out) == 0) | (m["start"] >= F.element_at(out, -1)["end"]), F.concat(out, F.array(m))).otherwise(out))
    return chains.select(key, F.inline(kept)).select(key, "start", "end", "name")


def resolved(requests: DataFrame, named: DataFrame, acts: DataFrame, sections: DataFrame) -> DataFrame:
    """What citations by name refer to: key, status, slug, section_id, heading.

    ``requests`` has key, name (as written) and section; ``named`` is an
    ``index``; ``acts`` and ``sections`` are what ``citations.validated`` takes. Statuses:
    missing-act (no name), unknown-act, repealed-act (only acts that are no longer
    current; their slug if it is one), ambiguous-act (several current ones), then of the section valid,
    nonexistent-section, ambiguous-occurrence, or unresolved where it cannot be read.
    """
    current = F.col("status") == "current"
    by_key = named.groupBy("key").agg(
        F.count_if(current).alias("n_current"), F.min(F.when(current, F.col("slug"))).alias("current_slug"), F.min("slug").alias("low"), F.max("slug").alias("high")
    )
    asked = requests.select(F.col("key").alias("id"), nfkc_folded("name").alias("key"), F.col("section").cast("string").alias("section"))
    met = asked.join(by_key, "key", "left")
    one = F.col("n_current") == 1
    cited = F.concat("current_slug", F.lit(" § "), F.coalesce("section", F.lit("")))
    verdicts = citations.validated(met.where(one).select(F.col("id").alias("key"), cited.alias("citation")), acts, sections)
    told = met.join(verdicts.select(F.col("key").alias("id"), F.col("slug").alias("found"), "section_id", "heading", "reason"), "id", "left")
    same = (F.col("found") == F.col("current_slug")) & F.col("section_id").isNotNull()
    status = (
        F.when(F.coalesce("key", F.lit("")) == "", "missing-act")
        .when(F.col("n_current").isNull(), "unknown-act")
        .when(F.col("n_current") == 0, "repealed-act")
        .when(~one, "ambiguous-act")
        .when(~F.coalesce(same, F.lit(False)), "unresolved")
        .when(F.col("reason").isNull(), "valid")
        .when(F.col("reason") == "no_section", "nonexistent-section")
        .when(F.col("reason") == "ambiguous_section", "ambiguous-occurrence")
        .otherwise("unresolved")
    )
    slug = F.when(F.col("n_current") == 0, F.when(F.col("low") == F.col("high"), F.col("low"))).when(F.col("status").isin("valid", "nonexistent-section", "ambiguous-occurrence"), F.col("current_slug"))
    sectioned = F.col("status").isin("valid", "nonexistent-section", "ambiguous-occurrence")
    return told.withColumn("status", status).select(
        F.col("id").alias("key"), "status", slug.alias("slug"), F.when(sectioned, F.col("section_id")).alias("section_id"), F.when(F.col("status") == "valid", F.col("heading")).alias("heading")
    )
