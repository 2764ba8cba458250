"""Text gates, near-duplicate pairs, quotes and personal data by line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import quote_folded
from ..session import written
from .graph import clusters

#: Least length, least share of function words, largest share of unprintable characters, least similarity.
LEAST_CHARS, LEAST_FUNCTION, MOST_UNPRINTABLE, SIMILAR = 200, 0.05, 0.01, 0.8
#: Copies of one text are dealt over so many slots.
SLOTS = 24
#: Sets looked at at once, what rounding may add, and prefixes that a shingle may be in before it comes last; rounds of counting, and shingles that come last, at most.
LOT, SLACK, OFTEN, ROUNDS, MOST_COMMON = 1024, 1e-6, 50, 6, 200_000
#: Short quotes are looked up by so many characters at most.
LETTERS = 16
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
PHONE = r"\+[0-9][0-9 ().-]{7,}[0-9]"
ADDRESS = r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b"


def function_share(text: Column, words: Column) -> Column:
    """Share of the words that are function words."""
    held = F.array_remove(F.split(F.lower(text), r"[^\p{L}]+"), "")
    return F.coalesce(F.try_divide(F.size(F.filter(held, lambda w: F.array_contains(words, w))), F.size(held)), F.lit(0.0))


def holds(text: Column, words: Column) -> Column:
    """Why a text is held back, the first that applies; null where it passes."""
    odd = F.regexp_count(text, F.lit(r"[\p{Cc}\p{Co}\p{Cn}\uFFFD&&[^\n\r\t]]"))
    return (
        F.when(F.length(F.trim(text)) < LEAST_CHARS, "empty")
        .when(function_share(text, words) < LEAST_FUNCTION, "garbled")
        .when(odd > F.length(text) * MOST_UNPRINTABLE, "unprintable")
    )


def line_hits(rows: DataFrame, key: str) -> DataFrame:
    """Lines with personal data, by kind, for rows of (key, line_no, line)."""
    kinds = F.array(
        *(F.when(F.col("line").rlike(pattern), F.lit(kind)) for kind, pattern in (("email", EMAIL), ("phone", PHONE), ("address", ADDRESS)))
    )
    return rows.select(key, "line_no", F.explode(F.array_compact(kinds)).alias("kind"))


def run_hash(words: Column, start: Column, size: int) -> Column:
    """The hash of ``size`` words from ``start`` (from 0), word by word, so that none are joined or copied."""
    return F.xxhash64(*(F.get(words, start + k) for k in range(size)))


def run_hashes(words: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; the words are computed once a row, even where Spark moves them into the lambda."""

    def hashed(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))
        return F.transform(starts, lambda i: run_hash(w, i, size))

    return F.transform(F.array(words), hashed)[0]


def shingle_words() -> Column:
    return F.array_remove(F.split(F.lower("text"), r"[\x20\x09-\x0D]+"), "")


def shingle_set(words: Column, size: int) -> Column:
    return F.array_sort(F.array_distinct(run_hashes(words, size)))


def shingle_rows(docs: DataFrame, size: int = 5) -> DataFrame:
    """doc_id, set_key, n and s (the sorted distinct hashes of ``size``-word shingles) of every row, written once; null for texts of under ``size`` words."""
    held = docs.select("doc_id", shingle_words().alias("w"))
    # the words are bound, so that Spark builds them once
    sets = held.select("doc_id", F.when(F.size("w") >= size, shingle_set(F.col("w"), size)).alias("s"))
    key = F.sha2(F.array_join(F.col("s").cast("array<string>"), ","), 256)
    return written(sets.select("doc_id", key.alias("set_key"), F.size("s").alias("n"), "s"), "shingles")


def prefix_size(n, similar: float):
    """So many of a set's ``n`` shingles, first in any order common to all sets, hold one of every set as similar as asked."""
    return n - np.ceil(n * similar - SLACK).astype(np.int64) + 1


def prefixed(s: pa.ListArray, similar: float, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted sets, none empty: all shingles, which of them are in their set's prefix, the prefixes' sizes and their last places in the order.

    The order is by hash, with the shingles of ``common`` (sorted) after all others.
    """
    offsets = s.offsets.to_numpy().astype(np.int64)
    values = s.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    starts, n = offsets[:-1] - offsets[0], np.diff(offsets)
    size = prefix_size(n, similar)
    late = np.zeros(len(values), dtype=bool)
    if len(common):
        late = common[np.minimum(np.searchsorted(common, values), len(common) - 1)] == values
    early = np.cumsum(~late)
    before = np.concatenate([[0], early])[starts]
    rank = early - np.repeat(before, n)
    held = np.concatenate([early[starts[1:] - 1], early[-1:]]) - before
    # those that are late have the places after the set's early ones
    inside = np.arange(len(values)) - np.repeat(starts, n) + 1
    rank = np.where(late, inside - rank + np.repeat(held, n), rank)
    taken = rank <= np.repeat(size, n)
    places = (values >> 3) + np.where(late, 1 << 61, 0)
    return values, taken, size, np.maximum.reduceat(np.where(taken, places, places.min()), starts)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, LOT):
            yield batch.slice(low, LOT)


def common_shingles(rows: DataFrame, similar: float) -> np.ndarray:
    """Shingles that more than ``OFTEN`` sets have in their prefix, sorted. They come last in the order, which brings others into prefixes; these are counted in their turn.

    Only the pairs that are compared in vain depend on what is found here.
    """
    common, last = np.zeros(0, dtype=np.int64), None
    for _ in range(ROUNDS):

        def fresh(batches: Iterator[pa.RecordBatch], common=common, last=last) -> Iterator[pa.RecordBatch]:
            for lot in _lots(batches):
                values, taken, *_ = prefixed(lot.column("s"), similar, common)
                if last is not None:
                    taken &= ~prefixed(lot.column("s"), similar, last)[1]
                yield pa.RecordBatch.from_arrays([pa.array(values[taken])], names=["g"])

        counts = rows.select("s").mapInArrow(fresh, "g long").groupBy("g").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > OFTEN)
        found = np.array([r["g"] for r in counts.orderBy(F.desc("df"), "g").limit(MOST_COMMON).collect()], dtype=np.int64)
        common, last = np.union1d(common, found), common
        if len(common) == len(last) or len(common) >= MOST_COMMON:
            break
    return common


def _pairs(rows: DataFrame, similar: float) -> DataFrame:
    """Pairs (a, b, jaccard) of the classes of ``shingle_rows``, by their smallest ids."""
    held = rows.where("set_key IS NOT NULL")
    common = common_shingles(held, similar)
    schema = T.StructType([*held.select("set_key", "doc_id", "n").schema.fields, T.StructField("last", T.LongType()), T.StructField("first", T.ArrayType(T.LongType()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _lots(batches):
            values, taken, size, last = prefixed(lot.column("s"), similar, common)
            first = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values[taken]))
            yield pa.RecordBatch.from_arrays([*(lot.column(c) for c in ("set_key", "doc_id", "n")), pa.array(last), first], names=schema.names)

    # copies are folded while only prefixes move
    folded = held.select("set_key", "doc_id", "n", "s").mapInArrow(cut, schema).groupBy("set_key")
    classes = folded.agg(F.min("doc_id").alias("doc_id"), *(F.any_value(c).alias(c) for c in ("n", "last", "first")))
    prefix = classes.select("doc_id", "n", "last", F.explode("first").alias("g"))
    ends = [prefix.select(F.col("doc_id").alias(e), F.col("n").alias(f"n{e}"), F.col("last").alias(f"last{e}"), "g") for e in "ab"]
    close = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similar - SLACK)
    met = ends[0].join(ends[1], "g").where(close).groupBy("a", "na", "lasta", "b", "nb", "lastb").agg(F.count(F.lit(1)).alias("c"))
    # of the prefix that ends first, what the other one has not got is not in the other set at all
    rest = {e: F.ceil(F.col(f"n{e}") * similar - SLACK) - 1 for e in "ab"}
    most = F.col("c") + F.when(F.col("lasta") < F.col("lastb"), rest["a"]).when(F.col("lasta") > F.col("lastb"), rest["b"]).otherwise(F.greatest(*rest.values()))
    likely = met.where(most >= (F.col("na") + F.col("nb")) * similar / (1 + similar) - SLACK)
    likely = written(likely.select("a", "na", "b", "nb"), "likely")
    # only the sets of such pairs are moved whole
    asked = likely.select(F.col("a").alias("doc_id"), F.col("na").alias("n")).union(likely.select("b", "nb")).distinct()
    sets = held.select("doc_id", "n", "s").join(asked, ["doc_id", "n"], "left_semi").dropDuplicates(["doc_id", "n"])
    whole = [sets.select(F.col("doc_id").alias(e), F.col("n").alias(f"n{e}"), F.col("s").alias(f"s{e}")) for e in "ab"]
    both = F.size(F.array_intersect("sa", "sb"))
    jaccard = both / (F.size("sa") + F.size("sb") - both)
    return likely.join(whole[0], ["a", "na"]).join(whole[1], ["b", "nb"]).select("a", "b", F.round(jaccard, 6).alias("jaccard")).where(jaccard >= similar)


def shingle_pairs(docs: DataFrame, size: int = 5, similar: float = SIMILAR) -> DataFrame:
    """Pairs of texts whose sets of ``size``-word shingles have a Jaccard similarity of at least ``similar``.

    Only different sets are paired: copies are folded to the one with the
    smallest id, and ``shingle_members`` says which texts it stands for. Two sets as similar as
    asked must share one of the first few shingles (the prefix filter) in any order that is the same for all: here by hash,
    with those that many prefixes have last. How many they share there bounds what they share
    at all; the sets of pairs that may be similar are then compared whole.
    """
    return _pairs(shingle_rows(docs, size), similar)


def shingle_members(docs: DataFrame, size: int = 5, similar: float = SIMILAR) -> DataFrame:
    """Every row of ``docs`` with its class (the smallest id with the same shingle set), the rows in that class,
    its cluster (the smallest id reachable over copies and pairs) and the class's links in ``shingle_pairs``.

    Texts of under ``size`` words have no set, hence no class. A class is met by
    slots of documents, so that many copies fill no single task.
    """
    rows = shingle_rows(docs, size)
    keyed = rows.select("doc_id", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).alias("slot"))
    slots = keyed.where("set_key IS NOT NULL").groupBy("set_key", "slot").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    classes = slots.groupBy("set_key").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_copies"), F.collect_list("slot").alias("slots"))
    pairs = written(_pairs(rows, similar).select("a", "b"), "pairs")
    ends = pairs.select(F.col("a").alias("class_id")).union(pairs.select("b"))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    labels = clusters(pairs).select(F.col("node").alias("class_id"), "label")
    told = classes.join(labels, "class_id", "left").join(links, "class_id", "left")
    shown = told.select(
        "set_key", "class_id", "n_copies", F.coalesce("label", "class_id").alias("cluster_id"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.explode("slots").alias("slot"),
    )
    return keyed.join(shown, ["set_key", "slot"], "left").select("doc_id", "class_id", "n_copies", "cluster_id", "n_links")


def quotes_found(quotes: DataFrame, texts: DataFrame, words: int = 8) -> DataFrame:
    """Quotes (item_id, quote) that a text (doc_id, text) holds after folding; an empty quote is nowhere.

    A quote may begin and end inside a word, so a text is looked up by the
    quote's second word and those after it, at most ``words`` and without the
    last; quotes of under four words by their first characters. Each is met by
    runs of its own length (those that occur among the quotes), by an
    equi-join; the whole quote is then compared.
    """
    folded = quotes.select("item_id", quote_folded(F.col("quote")).alias("q")).where("q <> ''")
    parts = folded.select("item_id", "q", F.split("q", " ").alias("w"), F.split("q", "").alias("c"))
    # the length of the run; below zero for characters
    run = F.when(F.size("w") >= 4, F.least(F.size("w") - 2, F.lit(words))).otherwise(-F.least(F.size("c"), F.lit(LETTERS)))
    sized = parts.withColumn("run", run)
    cut = F.when(F.col("run") > 0, F.slice("w", F.lit(2), F.abs("run"))).otherwise(F.slice("c", F.lit(1), F.abs("run")))
    runs = sorted(r["run"] for r in sized.select("run").distinct().collect()) or [words]
    hashes = [F.when(F.col("run") == n, run_hash(F.col("cut"), F.lit(0), abs(n))) for n in runs]
    keyed = sized.withColumn("cut", cut).select("item_id", "q", F.coalesce(*hashes).alias("k"))
    body = written(texts.select("doc_id", quote_folded(F.col("text")).alias("t")), "folded")
    split = {True: F.split("t", " "), False: F.split("t", "")}
    grams = F.flatten(F.array(*(run_hashes(split[n > 0], abs(n)) for n in runs)))
    # texts are joined again by id, so that no text is repeated for each of its runs
    met = body.select("doc_id", F.explode(F.array_distinct(grams)).alias("k")).join(keyed, "k").select("doc_id", "item_id", "q")
    return met.join(body, "doc_id").where(F.contains("t", "q")).select("item_id", "doc_id").distinct()
