"""Sections of a text by its lines, and alignment of sections between versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import block_id, section_id

#: Fixed forms: a section heading, a chapter heading and any other heading.
SECTION = r"^#{2,6}\s*§\s*([0-9]+(?:\s*[a-zA-Z])?(?:-[0-9]+(?:\s*[a-zA-Z])?)*)\.?\s*(.*)$"
CHAPTER, BLOCK = r"^##\s+(.*)$", r"^#{2,6}\s+(.*)$"
HEADS = "array<struct<at:int,line:string,s:boolean,c:boolean,chapter:string>>"


def lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per line, numbered from 0."""
    return docs.select(key, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def line_groups(rows: DataFrame, key: str, starts: Column) -> DataFrame:
    """Number the groups of lines that begin where ``starts`` holds; lines before the first belong to group 0."""
    order = Window.partitionBy(key).orderBy("line_no")
    return rows.withColumn("group_no", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(order))


def layer(chapter: Column) -> Column:
    low = F.lower(chapter)
    return F.when(low.startswith("vedlegg"), "vedlegg").when(low.startswith("veileder"), "veileder").otherwise("main")


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, pos, section_id, occurrence, heading, parent_chapter, layer, kind, body.

    The section test comes before the chapter test; a level-two heading that is
    no section closes what is open and sets the chapter; any other heading opens
    a block whose id is its slug, or only closes what is open where it has none.
    A text is cut within its row: its lines are neither sorted nor shuffled.
    """
    cut = docs.select("doc_id", F.split("text", "\n").alias("lines"))
    numbered = F.transform("lines", lambda line, at: F.struct(at.alias("at"), line.alias("line")))
    heads = F.transform(F.filter(numbered, lambda x: x["line"].startswith("##")), lambda x: _head(x["at"], x["line"]))
    marked = cut.select("doc_id", "lines", F.filter(heads, lambda x: x["s"] | x["c"] | x["b"]).alias("heads"))
    none = F.struct(F.lit(None).cast("string").alias("chapter"), F.array().cast(HEADS).alias("all"))

    def under(held: Column, x: Column) -> Column:
        chapter = F.when(x["c"], F.regexp_extract(x["line"], CHAPTER, 1)).otherwise(held["chapter"])
        row = F.struct(x["at"].alias("at"), x["line"].alias("line"), x["s"].alias("s"), x["c"].alias("c"), chapter.alias("chapter"))
        return F.struct(chapter.alias("chapter"), F.concat(held["all"], F.array(row)).alias("all"))

    placed = marked.select("doc_id", "lines", F.aggregate("heads", none, under, lambda end: end["all"]).alias("heads"))

    def opened(x: Column, k: Column) -> Column:
        end = F.coalesce(F.get("heads", k + 1)["at"], F.size("lines"))
        label = F.when(x["s"], section_id(F.regexp_extract(x["line"], SECTION, 1))).otherwise(block_id(F.regexp_extract(x["line"], BLOCK, 1)))
        heading = F.when(x["s"], F.regexp_extract(x["line"], SECTION, 2)).otherwise(F.regexp_extract(x["line"], BLOCK, 1))
        body = F.trim(F.array_join(F.slice("lines", x["at"] + 2, end - x["at"] - 1), "\n"))
        return F.struct(F.when(~x["c"], label).alias("section_id"), heading.alias("heading"), x["chapter"].alias("parent_chapter"), x["s"].alias("s"), body.alias("body"))

    held = placed.select("doc_id", F.filter(F.transform("heads", opened), lambda x: x["section_id"] != "").alias("parts"))
    # equal ids come together, each in the order of the text
    ids = F.array_sort(F.transform("parts", lambda x, k: F.struct(x["section_id"].alias("id"), k.alias("k"))))
    told = held.select("doc_id", "parts", ids.alias("ids")).select("doc_id", "parts", "ids", F.col("ids.id").alias("names"))
    nth = F.array_sort(F.transform("ids", lambda x, k: F.struct(x["k"].alias("k"), (k + 2 - F.array_position("names", x["id"])).cast("int").alias("nth"))))
    counted = told.select("doc_id", "parts", nth.alias("nth"))

    def row(x: Column, k: Column) -> Column:
        chapter = x["parent_chapter"]
        return F.struct(
            (k + 1).alias("pos"), x["section_id"].alias("section_id"), x["heading"].alias("heading"), chapter.alias("parent_chapter"), layer(F.coalesce(chapter, F.lit(""))).alias("layer"),
            F.when(x["s"], "section").otherwise("block").alias("kind"), x["body"].alias("body"), F.get("nth", k)["nth"].alias("occurrence"),
        )

    return counted.select("doc_id", F.inline(F.transform("parts", row)))


def _head(at: Column, line: Column) -> Column:
    is_section = line.rlike(SECTION)
    is_chapter = ~is_section & line.rlike(CHAPTER)
    return F.struct(at.alias("at"), line.alias("line"), is_section.alias("s"), is_chapter.alias("c"), (~is_section & ~is_chapter & line.rlike(BLOCK)).alias("b"))


def requested(all_sections: DataFrame, requests: DataFrame) -> DataFrame:
    """Answer rows of (doc_id, section_id, occurrence or null): found, missing or ambiguous.

    Sections are shuffled once: a request meets the occurrence it asks for or,
    where there is none, the first one, which tells how many there are.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "section_id"))
    held = all_sections.select("doc_id", "section_id", F.col("occurrence").alias("__o"), "heading", "body", n.alias("n_same"))
    wanted = requests.withColumn("section_id", section_id(F.col("section_id"))).withColumn("__asked", F.coalesce("occurrence", F.lit(1)))
    r, s = wanted.alias("r"), held.alias("s")
    same = (F.col("r.doc_id") == F.col("s.doc_id")) & (F.col("r.section_id") == F.col("s.section_id"))
    met = F.col("s.__o") == F.when(F.col("r.__asked").between(1, F.col("s.n_same")), F.col("r.__asked")).otherwise(1)
    found = r.join(s, same & met, "left")
    unsure = (F.col("n_same") > 1) & F.col("occurrence").isNull()
    there = F.col("__o") == F.col("__asked")
    state = F.when(unsure, "ambiguous").when(there & F.col("body").isNotNull(), "found").otherwise("missing")
    shown = [F.when(there & ~unsure, F.col(c)).alias(c) for c in ("heading", "body")]
    return found.select("r.doc_id", "r.section_id", "occurrence", state.alias("state"), "n_same", *shown)


def section_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, removed and changed sections between two versions of documents.

    Repeated ids are paired by equal text first, then by order among the rest.
    Both versions go through one line of windows, so bodies are shuffled at most once.
    """
    sides = [rows.select("doc_id", "section_id", "occurrence", "body", F.lit(side).alias("side")) for side, rows in enumerate((before, after))]
    both = sides[0].unionByName(sides[1])
    line = Window.partitionBy("doc_id", "section_id", "body").orderBy("side", "occurrence")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.col("side") == 0
    counted = both.select("*", F.row_number().over(line).alias("nth"), F.count_if(first).over(every).alias("n_before"), F.count_if(~first).over(every).alias("n_after"))
    # of equal texts as many are paired as both sides have
    rest = counted.where(F.when(first, F.col("nth") > F.col("n_after")).otherwise(F.col("nth") - F.col("n_before") > F.col("n_before")))
    place = F.row_number().over(Window.partitionBy("doc_id", "section_id", "side").orderBy("occurrence"))
    placed = rest.select("doc_id", "section_id", "body", "side", place.alias("place"))
    met = placed.groupBy("doc_id", "section_id", "place").agg(F.max(F.when(first, F.col("body"))).alias("body_before"), F.max(F.when(~first, F.col("body"))).alias("body_after"))
    kind = F.when(F.col("body_before").isNull(), "added").when(F.col("body_after").isNull(), "removed").otherwise("changed")
    return met.withColumn("change_type", kind)
