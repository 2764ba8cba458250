"""Lookup and ranked substring search over the corpus."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WIDE_SPACES, collapsed

#: Results at most, results unless asked, characters of context to each side.
MOST, USUAL, CONTEXT = 100, 20, 50


def bounded(limit: int) -> int:
    if limit < 0:
        raise ValueError("a limit is not negative")
    return min(limit, MOST)


def match_count(text: Column, needle: str) -> Column:
    """Non-overlapping matches, without a regular expression."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle)))) / len(needle)).cast("long")


def snippet(text: Column, needle: str, context: int = CONTEXT) -> Column:
    """The first match with its surroundings on one line, with an ellipsis where it is cut."""
    lowered = F.lower(text)
    # lower case may be longer or shorter than the text; then the place is looked for in the text itself
    kept = F.regexp_instr(text, F.lit("(?iu)" + re.escape(needle)))
    at = F.when((F.length(lowered) == F.length(text)) | (kept == 0), F.instr(lowered, needle)).otherwise(kept)
    begin = F.greatest(at - context, F.lit(1))
    body = collapsed(F.substring(text, begin, at - begin + len(needle) + context))
    after = at + len(needle) + context - 1 < F.length(text)
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), body, F.when(after, "…").otherwise("")))


def body_search(docs: DataFrame, query: str, limit: int = USUAL) -> DataFrame:
    """Documents whose text has the query, most matches first, then by id."""
    needle = query.lower()
    if not needle.strip():
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("match_count"), F.lit("").alias("snippet"))
    lowered = F.lower("text")
    return (
        docs.where(F.contains(lowered, F.lit(needle)))
        .select("doc_id", "text", match_count(lowered, needle).alias("match_count"))
        .orderBy(F.desc("match_count"), "doc_id")
        .limit(bounded(limit))
        # snippets are cut for the rows that stay
        .select("doc_id", "match_count", snippet(F.col("text"), needle).alias("snippet"))
    )


#: Characters of a table row that are shown, longest query that markers may interrupt, and the form of a footnote marker.
ROW_CHARS, TOLERANT, MARKER = 1200, 2000, r"(?:\[\^[^\]\s]{1,16}\])?"


def one_line(text: Column) -> Column:
    """White space of any script as one space."""
    return F.trim(F.regexp_replace(text, WIDE_SPACES, " "))


def eligible(manifest: DataFrame, dataset: str | None = None) -> DataFrame:
    """Current records (doc_id, slug, title, status, dataset) of a slug that no other current record claims."""
    current = manifest.where("status = 'current' AND slug IS NOT NULL")
    claims = current.groupBy("slug").agg(F.count(F.lit(1)).alias("__claims")).where("__claims = 1")
    return (current.where(F.col("dataset") == dataset) if dataset else current).join(claims.select("slug"), "slug", "left_semi")


def text_search(manifest: DataFrame, bodies: DataFrame, query: str, dataset: str | None = None, limit: int = USUAL) -> DataFrame:
    """slug, doc_id, title, dataset, match_count and snippet of the eligible documents whose body (doc_id, text) has the query: most matches first, then by slug.

    Case does not matter. A footnote marker may stand anywhere inside a match
    (in queries of up to ``TOLERANT`` characters). The snippet is the first match on one line with its
    surroundings; of a match in a table row it is the row. A blank query finds nothing.
    """
    needle = query.lower()
    out = ["slug", "doc_id", "title", "dataset", "match_count", "snippet"]
    rows = eligible(manifest, dataset).join(bodies.select("doc_id", "text").where("text IS NOT NULL"), "doc_id")
    if not needle.strip():
        return rows.limit(0).select(*out[:4], F.lit(0).cast("long").alias("match_count"), F.lit("").alias("snippet"))
    lowered = F.lower(F.translate("text", "\u0130", "i"))  # the one letter whose lower case is longer
    marked = F.contains("text", F.lit("[^")) if len(needle) <= TOLERANT else F.lit(False)
    form = F.lit("(?s)" + MARKER.join(map(re.escape, needle)))
    count = F.when(marked, F.regexp_count(lowered, form)).otherwise(match_count(lowered, needle)).cast("long")
    found = rows.withColumn("match_count", count).where("match_count > 0").orderBy(F.desc("match_count"), "slug").limit(bounded(limit))
    at = F.when(marked, F.regexp_instr(lowered, form)).otherwise(F.instr(lowered, needle))
    size = F.when(marked, F.length(F.regexp_substr(lowered, form))).otherwise(len(needle))
    placed = found.withColumn("at", at).withColumn("size", size)
    # of the line that the match begins in
    before = F.substring_index(F.substring("text", F.lit(1), F.col("at") - 1), "\n", -1)
    row = F.substring_index(F.expr("substring(text, at)"), "\n", 1)
    begin = F.greatest(F.col("at") - CONTEXT, F.lit(1))
    end = F.col("at") + F.col("size") + CONTEXT
    window = one_line(F.substring("text", begin, end - begin))
    cut = F.concat(F.when(begin > 1, "...").otherwise(""), window, F.when(end - 1 < F.length("text"), "...").otherwise(""))
    whole = F.concat(before, row)
    return placed.withColumn("snippet", F.when(whole.startswith("|"), F.substring(one_line(whole), 1, ROW_CHARS)).otherwise(cut)).select(*out)


def record_search(manifest: DataFrame, query: str, dataset: str | None = None, limit: int = USUAL) -> DataFrame:
    """Current records whose slug and title together have the query, by doc_id; a blank query finds nothing."""
    rows = manifest.where("status = 'current'")
    rows = rows.where(F.col("dataset") == dataset) if dataset else rows
    held = F.lower(F.concat(F.coalesce("slug", F.lit("")), F.lit(" "), F.coalesce("title", F.lit(""))))
    return rows.where(F.contains(held, F.lit(query.lower())) & F.lit(bool(query.strip()))).orderBy("doc_id").limit(bounded(limit))


def title_search(titles: DataFrame, query: str, limit: int = USUAL) -> DataFrame:
    """``titles`` has doc_id, title and what else is to be shown; in id order."""
    hit = F.contains(F.lower("title"), F.lit(query.lower()))
    return titles.where(hit & F.lit(bool(query.strip()))).orderBy("doc_id").limit(bounded(limit))


def recent_changes(docs: DataFrame, since: str | None, limit: int = USUAL) -> DataFrame:
    """Newest first, then by id; rows without a change date do not take part."""
    rows = docs.where("last_changed IS NOT NULL")
    if since:
        rows = rows.where(F.col("last_changed") >= F.to_timestamp(F.lit(since)))
    return rows.orderBy(F.desc("last_changed"), "doc_id").limit(bounded(limit))


def members(docs: DataFrame, array: str, value: str) -> DataFrame:
    """Exact membership; a null array is unknown and never matches."""
    return docs.where(F.array_contains(F.col(array), value))


def status(docs: DataFrame, by: list[str]) -> DataFrame:
    """Counts per group, with the share of rows that have no text."""
    return docs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.countDistinct("doc_id").alias("n_ids"),
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("n_empty"),
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n_chars"),
    )
