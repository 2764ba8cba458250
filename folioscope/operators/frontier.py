"""A bounded walk over links: what is read, in which turn, and why everything else is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordering import numbered
from .robots import covered

#: Schemes that may be read.
SCHEMES = ("http", "https")


def off_source(urls: Column, host_is_covered: Column, schemes: tuple[str, ...] = SCHEMES) -> Column:
    """Why a URL is not the source's to read: its scheme, or its host; else null."""
    scheme = F.lower(F.regexp_extract(urls, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(~scheme.isin(*schemes), "unsupported_scheme").when(~F.coalesce(host_is_covered, F.lit(False)), "off_source_host")


def with_reasons(links: DataFrame, sources: DataFrame, target: str = "target") -> DataFrame:
    """``links`` with ``reason``: null where the target's host lies in the domain of a source (source, domain)."""
    host = F.lower(F.regexp_extract(F.col(target), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hosts = links.select(host.alias("host")).distinct()
    known = covered(hosts, sources).select("host").distinct().withColumn("__covered", F.lit(True))
    met = links.withColumn("host", host).join(known, "host", "left")
    return met.withColumn("reason", off_source(F.col(target), F.col("__covered"))).drop("host", "__covered")


def walked(entries: DataFrame, links: DataFrame, readable: DataFrame, max_depth: int, max_documents: int) -> DataFrame:
    """url, found_in, depth, turn, outcome: one row for every URL that was lined up, and one for every link that was not.

    ``entries`` have url, place and reason; ``links`` have url (the document that
    holds them), place, target and reason, which says why the target is not to be
    read; ``readable`` has the url of documents that can be. Documents are read in
    order: entries by place, then the links of what was read first. Outcomes of
    URLs in line: read, fetch_failed, or document_budget_exhausted once
    ``max_documents`` were read. Of links that are not lined up (no turn): the given
    reason, max_depth_exceeded, or already_read where the URL has been lined up before.

    One round of joins a level. A URL that very many links name is reduced to
    its first link before it meets anything.
    """
    there = readable.select("url").distinct().withColumn("__there", F.lit(True))
    named = entries.select(F.col("url").alias("target"), F.lit(None).cast("string").alias("found_in"), F.lit(0).cast("long").alias("turn"), "place", "reason")
    seen = out = None
    read = first_turn = 0
    for depth in range(max_depth + 2):
        named = written(named, "frontier-links")
        open_links = named.where("reason IS NULL") if depth <= max_depth else named.limit(0)
        refused = named.where("reason IS NOT NULL").select("target", "found_in", "reason")
        if depth > max_depth:
            refused = named.select("target", "found_in", F.coalesce("reason", F.lit("max_depth_exceeded")).alias("reason"))
        firsts = open_links.groupBy("target").agg(F.min(F.struct("turn", "place")).alias("first"))
        fresh = firsts if seen is None else firsts.join(seen, "target", "left_anti")
        fresh = written(fresh, "frontier-fresh")
        met = open_links.join(fresh.withColumnRenamed("first", "__first"), "target", "left")
        is_first = F.coalesce(F.struct("turn", "place") == F.col("__first"), F.lit(False))
        again = met.where(~is_first).select("target", "found_in", F.lit("already_read").alias("reason"))
        skipped = refused.unionByName(again).select(
            F.col("target").alias("url"), "found_in", F.lit(depth).alias("depth"), F.lit(None).cast("long").alias("turn"), F.col("reason").alias("outcome")
        )
        queue = met.where(is_first).select(F.col("target").alias("url"), "found_in", F.col("turn").alias("__turn"), "place").join(there, "url", "left")
        can = F.coalesce("__there", F.lit(False))
        placed = numbered(queue, ["__turn", "place"], "turn", can.cast("int"), "__read").select("url", "found_in", F.col("turn") + first_turn, F.col("__read") + read, can)
        placed = placed.toDF("url", "found_in", "turn", "__read", "__can")
        outcome = F.when(F.col("__read") >= max_documents, "document_budget_exhausted").when(F.col("__can"), "read").otherwise("fetch_failed")
        lined = written(placed.select("url", "found_in", F.lit(depth).alias("depth"), "turn", outcome.alias("outcome")), "frontier-lined")
        level = lined.unionByName(skipped)
        out = level if out is None else out.unionByName(level)
        here = lined.select(F.col("url").alias("target"))
        seen = here if seen is None else seen.unionByName(here)
        told = lined.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "read").alias("read")).first()
        first_turn, read = first_turn + told["n"], read + told["read"]
        if not told["read"]:
            break
        taken = lined.where("outcome = 'read'").select("url", "turn")
        named = links.join(taken, "url").select("target", F.col("url").alias("found_in"), "turn", "place", "reason")
    return out
