"""Repeated passages by a sparse suffix array.

Suffixes are kept at anchors alone: places chosen by content, at least one in
every ``GRAM + COUNT - 1`` words (see passages). A passage of ``LEAST`` words that
occurs twice has its first anchor within ``COUNT`` words of its start, so both
suffixes share at least ``PREFIX`` words from there. Suffixes that share those words with another are sorted, once
by what follows and once by what precedes, neighbours are compared word by word, and
the matches are extended left and right, up to ``LEFT`` and ``RIGHT`` words; a
longer passage is the union of the matches of its anchors.

A passage shared in part to the left and in part to the right may lie far off in
both orders. Where a prefix has more suffixes than neighbours are compared, the
``LEAST``-word windows that hold the anchor are therefore hashed and grouped too,
so the verdict does not depend on how many variants there are.

Suffixes that agree in all of that neighbourhood match each other whole, and
one of them stands for all in the sort, so copies cost no comparison.

Defined results: a null or empty text has no words and no passage; a document
may repeat itself; rows are documents of their own, also where they share a
doc_id or repeat whole, so a row's passages are places of its own words; ids may
be of any ordered type and a null one is an id like others; further columns are
not looked at; very long texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, documents, heavy, plan_partitions, slabs, text_or_empty, written
from .passages import in_one_text, mixed, sequence_hashes, stretch_hashes, window_anchors, word_hashes
from .substring_dedup import packed, plain, same_row

LEAST, GRAM, COUNT = 50, 6, 23
PREFIX = LEAST - COUNT + 1
LEFT, RIGHT = COUNT - 1, 88
#: Prefixes over this part of all are dealt by document as well, in so many slots.
HEAVY_PARTS, SLOTS = 100, 24
#: How far apart in the sorted order suffixes are compared.
NEIGHBOURS = 4
#: Words that the cuts between partitions of the sorted order look at.
CUT_WORDS = 8
#: A place packs the word number with the words at hand to its left and right.
BITS = 8


def _suffixes(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, prefix hash, neighbourhood hash and place of each kept suffix."""
    words, starts = word_hashes(texts)
    none = np.zeros(0, dtype=np.int64)
    if len(words) < LEAST:
        return none, none, none, none
    anchor = np.unique(window_anchors(sequence_hashes(words, GRAM), COUNT)[in_one_text(starts, GRAM + COUNT - 1, len(words) - GRAM - COUNT + 2)])
    text = np.searchsorted(starts, anchor, side="right") - 1
    left = np.minimum(anchor - starts[text], LEFT)
    right = np.minimum(starts[text + 1] - anchor, RIGHT)
    whole = (right >= PREFIX) & (left + right >= LEAST)
    anchor, text, left, right = anchor[whole], text[whole], left[whole], right[whole]
    prefix = sequence_hashes(words, PREFIX)[anchor]
    width = left + right
    around = mixed(stretch_hashes(words, anchor - left, width) + (width * 256 + left).astype(np.uint64))
    place = ((anchor - starts[text]) << (2 * BITS)) | (left << BITS) | right
    return text, prefix.view(np.int64), around.view(np.int64), place


def _parts(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << BITS) - 1
    return place >> (2 * BITS), (place >> BITS) & mask, place & mask


def suffixes(docs: DataFrame) -> DataFrame:
    """prefix, around, key, doc_id, place of every kept suffix."""
    long = T.LongType()
    schema = T.StructType([T.StructField("prefix", long), T.StructField("around", long), T.StructField("key", long), docs.schema["doc_id"], T.StructField("place", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = (batch.column(k) for k in range(3))
            for cut in slabs(pc.binary_length(texts).to_pylist()):
                text, prefix, around, place = _suffixes(texts[cut].to_pylist())
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefix), pa.array(around), keys[cut].take(at), ids[cut].take(at), pa.array(place)],
                    names=[f.name for f in schema.fields],
                )

    return plain(docs).mapInArrow(run, schema)


def _shared(rows: DataFrame) -> DataFrame:
    """Suffixes whose prefix occurs again: ``other`` where the whole neighbourhood does, ``compare`` where neighbours must tell.

    ``rows`` is a written table. Heavy prefixes (a sketch over all rows names
    them) are told from grouped minima, which are combined before the shuffle.
    """
    crowded = heavy(rows, "prefix", HEAVY_PARTS)
    shown = ["prefix", "key", "doc_id", "place", "whole", "other", "compare", "many"]
    order = Window.partitionBy("prefix").orderBy("around", F.col("doc_id").asc_nulls_last(), "place")
    beside = rows.where(~F.col("prefix").isin(crowded))
    for name, step in (("before", F.lag), ("after", F.lead)):
        beside = beside.withColumn(name, step(F.struct("around", "doc_id")).over(order))
    beside = beside.where("before IS NOT NULL OR after IS NOT NULL")
    first = ~F.coalesce(F.col("before.around") == F.col("around"), F.lit(False))
    last = ~F.coalesce(F.col("after.around") == F.col("around"), F.lit(False))
    group = Window.partitionBy("prefix")
    told = (
        beside.withColumn("first", first)
        .withColumn("alone", first & last)
        .withColumn("whole", ~(first & last))
        .withColumn("other", F.when(~first, F.col("before.doc_id")).when(~last, F.col("after.doc_id")))
        .withColumn("kinds", F.sum(F.col("first").cast("int")).over(group))
        .withColumn("loners", F.sum(F.col("alone").cast("int")).over(group))
    )
    told = told.withColumn("compare", F.col("first") & (F.col("kinds") > 1) & (F.col("loners") > 0))
    # so few lie within NEIGHBOURS of each other in any order
    told = told.withColumn("many", F.col("kinds") > NEIGHBOURS + 1)
    light = told.where("whole OR compare").select(*shown)
    if not crowded:
        return light
    at = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")
    slots = F.sequence(F.lit(0).cast("long"), F.lit(SLOTS - 1).cast("long"))
    crowd = rows.where(F.col("prefix").isin(crowded))
    groups = crowd.groupBy("prefix", "around").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(F.lit(1)).alias("n"))
    # a group of many rows is met by document as well, so its ends go to every slot
    groups = groups.where("n > 1").withColumn("slot", F.explode(slots)).drop("n")
    met = crowd.withColumn("slot", F.pmod(F.col("key"), F.lit(SLOTS))).join(groups, ["prefix", "around", "slot"], "left")
    leads = F.col("low").isNull() | (F.col("low") == at)
    other = F.when(leads, F.col("high.doc_id")).otherwise(F.col("low.doc_id"))
    met = met.withColumn("whole", F.col("low").isNotNull()).withColumn("other", other).withColumn("compare", leads).withColumn("many", F.lit(True))
    return light.unionByName(met.select(*shown))


def _contexts(texts: DataFrame) -> DataFrame:
    """prefix, to_right, to_left, key, doc_id, place: the word hashes to either side, big-endian, so that bytes sort as the words do.

    Rows without contexts are windows of the anchors with many suffixes: the hash as prefix, the first word as place.
    """
    schema = T.StructType([T.StructField("prefix", T.LongType()), T.StructField("to_right", T.BinaryType()), T.StructField("to_left", T.BinaryType()), T.StructField("key", T.LongType()), texts.schema["doc_id"], T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row, kept in enumerate(batch.column(3).to_pylist()):
                words, _ = word_hashes([expand(batch.column(2)[row].as_py())])
                held = (words >> np.uint64(32)).astype(">u4")
                rows, many = [], []
                for item in kept:
                    at, left, right = (int(x) for x in _parts(np.int64(item["place"])))
                    rows.append((item["prefix"], held[at : at + right].tobytes(), held[at - left : at][::-1].tobytes(), item["place"]))
                    if item["many"]:
                        many.append(np.arange(at - left, min(at, at + right - LEAST) + 1))
                if many:
                    start = np.unique(np.concatenate(many))
                    n, blank = len(start), pa.nulls(len(start), pa.binary())
                    window = sequence_hashes(words, LEAST)[start].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(window), blank, blank, pa.repeat(batch.column(0)[row], n), pa.repeat(batch.column(1)[row], n), pa.array(start)], names=[f.name for f in schema.fields]
                    )
                if rows:
                    columns = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.repeat(batch.column(0)[row], len(rows)), pa.repeat(batch.column(1)[row], len(rows)), pa.array(columns[3], pa.int64())],
                        names=[f.name for f in schema.fields],
                    )

    return texts.select("key", "doc_id", "text", "kept").mapInArrow(run, schema)


def agreement(a: bytes, b: bytes) -> int:
    """Leading words that two contexts share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // 4
    x, y = np.frombuffer(a[:n], np.uint32), np.frombuffer(b[:n], np.uint32)
    return int(np.argmax(x != y))


def _neighbours(sorted_rows: DataFrame) -> DataFrame:
    """Matches (key, doc_id, start, end, other) between neighbours of each partition; and its first and last rows, for the cuts between partitions."""
    id_field = sorted_rows.schema["doc_id"]
    fields = [T.StructField("key", T.LongType()), id_field, T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("other", id_field.dataType)]
    edge_fields = [T.StructField("prefix", T.LongType()), T.StructField("to_right", T.BinaryType()), T.StructField("to_left", T.BinaryType()), T.StructField("place", T.LongType())]
    schema = T.StructType([*fields, *edge_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque(maxlen=NEIGHBOURS)  # the suffixes before
        seen, kind = 0, pa.null()
        edges: list = []
        for batch in batches:
            out, kind = [], batch.column(3).type
            for row in zip(*(batch.column(k).to_pylist() for k in range(6))):
                seen += 1
                if seen <= NEIGHBOURS:
                    edges.append(row)
                for beside in held:
                    if beside[0] != row[0]:
                        continue
                    right, left = agreement(beside[1], row[1]), agreement(beside[2], row[2])
                    if left + right >= LEAST:
                        for one, two in ((beside, row), (row, beside)):
                            at = one[4] >> (2 * BITS)
                            out.append((one[5], one[3], at - left, at + right, two[3]))
                held.append(row)
            if out:
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), kind, pa.int64(), pa.int64(), kind))]
                blank = [pa.nulls(len(out), t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + blank, names=[f.name for f in schema.fields])
        edges += list(held)[max(0, NEIGHBOURS - (seen - len(held))) :] if seen > NEIGHBOURS else []
        if edges:
            prefix, to_right, to_left, doc, place, key = zip(*edges)
            n = len(edges)
            columns = [pa.array(key, pa.int64()), pa.array(doc, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, kind)]
            columns += [pa.array(prefix, pa.int64()), pa.array(to_right, pa.binary()), pa.array(to_left, pa.binary()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return sorted_rows.select("prefix", "to_right", "to_left", "doc_id", "place", "key").mapInArrow(run, schema)


def _compared(contexts: DataFrame) -> DataFrame:
    """Matches between neighbours of the sorted suffixes. ``contexts`` is a written table.

    The sorted order is cut by range, so that one prefix fills no single task;
    the rows at the cuts are then compared across them.
    """
    parts, out = plan_partitions(contexts), None
    # the cuts are sampled through the driver, so they look at a few words alone: those after the prefix, which all its suffixes share
    after, ahead = F.substring("to_right", 4 * PREFIX + 1, 4 * CUT_WORDS), F.substring("to_left", 1, 4 * CUT_WORDS)
    # a neighbour by what follows shares most to the right, one by what precedes most to the left
    for order, near in ((["prefix", "to_right", "to_left"], after), (["prefix", "to_left", "to_right"], ahead)):
        found = written(_neighbours(contexts.repartitionByRange(parts, "prefix", near).sortWithinPartitions(*order)), "neighbours")
        edges = found.where("start IS NULL").repartition("prefix").sortWithinPartitions(*order)
        across = _neighbours(edges).where("start IS NOT NULL")
        both = found.where("start IS NOT NULL").unionByName(across).select("key", "doc_id", "start", "end", "other")
        out = both if out is None else out.unionByName(both)
    return out


def _windows(rows: DataFrame) -> DataFrame:
    """Matches of whole windows (window, key, doc_id, start; a written table): each with the least, or the last, that is the same.

    Heavy windows are met by document as well.
    """
    crowded = F.col("window").isin(heavy(rows, "window", HEAVY_PARTS))
    at, none = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "start"), F.lit(0).cast("long")
    slots = F.sequence(none, F.lit(SLOTS - 1).cast("long"))
    groups = rows.groupBy("window").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.withColumn("slot", F.explode(F.when(crowded, slots).otherwise(F.array(none)))).drop("n")
    slot = F.when(crowded, F.pmod(F.col("key"), F.lit(SLOTS))).otherwise(none)
    other = F.when(F.col("low") == at, F.col("high.doc_id")).otherwise(F.col("low.doc_id"))
    met = rows.withColumn("slot", slot).join(groups, ["window", "slot"])
    return met.select("key", "doc_id", "start", (F.col("start") + LEAST).alias("end"), other.alias("other"))


def matches(docs: DataFrame) -> DataFrame:
    """key, doc_id, start, end, other: stretches of at least LEAST words that occur again, in ``other`` among them."""
    shared = written(_shared(written(suffixes(docs), "suffixes")), "shared")
    mask = F.lit((1 << BITS) - 1)
    at, left, right = F.expr(f"shiftright(place, {2 * BITS})"), F.expr(f"shiftright(place, {BITS})").bitwiseAND(mask), F.col("place").bitwiseAND(mask)
    whole = shared.where("whole").select("key", "doc_id", (at - left).alias("start"), (at + right).alias("end"), "other")
    kept = shared.where("compare").groupBy("key", "doc_id").agg(F.collect_set(F.struct("prefix", "place", "many")).alias("kept"))
    rows = packed(docs)
    texts = rows.join(kept, same_row(rows, kept)).select(rows["key"], rows["doc_id"], "text", "kept")
    contexts = written(_contexts(texts), "contexts")
    windows = contexts.where("to_right IS NULL").select(F.col("prefix").alias("window"), "key", "doc_id", F.col("place").alias("start"))
    return whole.unionByName(_compared(contexts.where("to_right IS NOT NULL"))).unionByName(_windows(windows))


def repeated(docs: DataFrame) -> DataFrame:
    """Every row with its words, the words in repeated passages, their spans (start:end in words) and the smallest id of the documents met."""
    found = matches(docs).groupBy("key", "doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs"), F.min("other").alias("other_id"))
    fresh = F.struct(F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    zero = F.struct(F.array().cast("array<struct<start:bigint,end:bigint>>").alias("done"), fresh.alias("open"))

    def step(a, run):
        apart = a["open"]["end"].isNull() | (run["start"] > a["open"]["end"])
        done = F.when(apart & a["open"]["end"].isNotNull(), F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        start = F.when(apart, run["start"]).otherwise(a["open"]["start"])
        end = F.when(apart, run["end"]).otherwise(F.greatest(a["open"]["end"], run["end"]))
        return F.struct(done.alias("done"), F.struct(start.alias("start"), end.alias("end")).alias("open"))

    merged = F.aggregate("runs", zero, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    spans = found.select(
        "key",
        "doc_id",
        "other_id",
        F.transform(merged, lambda r: F.concat_ws(":", r["start"].cast("string"), r["end"].cast("string"))).alias("spans"),
        F.aggregate(merged, F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_repeated"),
    )
    sizes = docs.select("doc_id", text_or_empty().alias("text"))
    sizes = sizes.select(
        F.xxhash64("doc_id", F.encode("text", "UTF-8")).alias("key"), "doc_id", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words")
    )
    return sizes.join(spans, same_row(sizes, spans), "left").select(
        sizes["doc_id"],
        "n_words",
        F.coalesce("n_repeated", F.lit(0).cast("long")).alias("n_repeated"),
        F.coalesce(F.concat_ws(",", "spans"), F.lit("")).alias("spans"),
        "other_id",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(documents(spark, sf_dir))
