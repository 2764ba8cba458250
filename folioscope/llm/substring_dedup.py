"""Removal of repeated 20-word windows with a log-structured fingerprint index.

A batch of documents becomes a run: one row per anchor of its windows (see
passages), with a 96-bit fingerprint of the anchor's whole neighbourhood, written once
as a table bucketed and sorted by anchor. A new run is merged with the older
ones on the anchor; buckets meet without a shuffle. Candidates that share an
anchor are then verified: where the fingerprint of the whole neighbourhood is one
that occurred before, every window of the anchor did; where only the anchor did,
the texts are read again and the windows themselves are hashed (96 bits) and
compared. Older runs count as earlier; within a batch the smaller
doc_id, then the earlier start. Runs are never changed; ``compact`` writes many
as one. An index can be opened again by its path.

Anchors that hold over a quarter of a bucket's share (a sketch over all rows
names them; their number is bounded) are dealt over slots by document: each slot
finds its own first occurrence, and the least of those is the first of all.
So a passage in a third of all documents fills no single task.

Defined results: a null or empty text has no words; texts under 20 words lose
none; rows that share a doc_id are one document with several texts: each row is
cut by its own words, a window is repeated where its words start earlier (at a
smaller doc_id, or at a smaller word number of the same id), and so rows that
repeat whole lose nothing to each other; a null doc_id comes after all others;
ids may be of any ordered type; further columns are not looked at; very long
texts are taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_by_id, documents, exists, heavy, removed, shared_dir, slabs, text_or_empty, written
from .passages import in_one_text, mixed, sequence_hashes, stretch_hashes, window_anchors, word_hashes

SPAN, GRAM = 20, 6
COUNT = SPAN - GRAM + 1
#: Buckets of an index at least, bytes of text a bucket is made for, and Spark's own bound on buckets.
LEAST_BUCKETS, BUCKET_BYTES, MOST_BUCKETS = 24, 128 << 20, 100_000
#: Slots that a heavy anchor is dealt over, by document; anchors over this part of a run are heavy at least.
SLOTS, LEAST_PARTS = 24, 400
#: A place packs the anchor's word number with how far its first and last window start before it.
PLACE_BITS = 5


def _anchor_rows(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of a batch: text number, anchor hash, neighbourhood hash, a second one, and place of each anchor."""
    words, starts = word_hashes(texts)
    none = np.zeros(0, dtype=np.int64)
    if len(words) < SPAN:
        return none, none, none, none.astype(np.int32), none
    grams = sequence_hashes(words, GRAM)
    at = window_anchors(grams, COUNT)
    ok = in_one_text(starts, SPAN, len(at))
    window, anchor = np.nonzero(ok)[0], at[ok]
    if not len(window):
        return none, none, none, none.astype(np.int32), none
    text = np.searchsorted(starts, window, side="right") - 1
    # windows of one anchor follow one another; a new text begins a new anchor
    fresh = np.ones(len(window), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.nonzero(fresh)[0]
    last = np.append(first[1:], len(window)) - 1
    low, high, mid = window[first], window[last], anchor[first]
    # the words from the first window's start to the last window's end, and where the anchor lies in them
    width = high - low + SPAN
    shape = (width * 64 + (mid - low)).astype(np.uint64)
    neighbourhood = mixed(stretch_hashes(words, low, width) + shape)
    second = mixed(stretch_hashes(mixed(words), low, width) + shape) >> np.uint64(32)
    place = ((mid - starts[text[first]]) << (2 * PLACE_BITS)) | ((mid - low) << PLACE_BITS) | (mid - high)
    return text[first], grams[mid].view(np.int64), neighbourhood.view(np.int64), second.astype(np.uint32).view(np.int32), place


def _windows_of(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last window start, as word numbers of their text."""
    mid = place >> (2 * PLACE_BITS)
    mask = (1 << PLACE_BITS) - 1
    return mid - ((place >> PLACE_BITS) & mask), mid - (place & mask)


def anchors(docs: DataFrame) -> DataFrame:
    """anchor, around, check, key, doc_id, place of every anchor of ``docs`` (key, doc_id, text as binary)."""
    long = T.LongType()
    fields = [T.StructField("anchor", long), T.StructField("around", long), T.StructField("check", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("key", long), docs.schema["doc_id"], T.StructField("place", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids, texts = (batch.column(k) for k in range(3))
            for cut in slabs(pc.binary_length(texts).to_pylist()):
                text, anchor, around, check, place = _anchor_rows(texts[cut].to_pylist())
                at = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor), pa.array(around), pa.array(check), keys[cut].take(at), ids[cut].take(at), pa.array(place)],
                    names=[f.name for f in schema.fields],
                )

    return docs.select("key", "doc_id", "text").mapInArrow(run, schema)


def plain(docs: DataFrame) -> DataFrame:
    """key, doc_id, text: the key is of the row, not of the id alone."""
    rows = docs.select("doc_id", F.encode(text_or_empty(), "UTF-8").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def packed(docs: DataFrame) -> DataFrame:
    """The texts compressed, for the one shuffle that they take."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            small = pa.array([squeeze(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), small], names=["key", "doc_id", "text"])

    rows = plain(docs)
    return rows.mapInArrow(run, rows.schema).repartition("key")


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Rows of ``right`` belong to a row where key and id agree."""
    return (left["key"] == right["key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def buckets_for(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)))


class FingerprintIndex:
    """Runs of anchors in the shared folder, oldest first.

    ``slot`` is -1, or for a heavy anchor one of SLOTS by document. The number of
    buckets is fixed for all runs, so it is chosen for the documents expected. A
    session that opens the index by its path finds the runs by the table that lists them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = LEAST_BUCKETS):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets, self.runs, self.heavy, self.batches, self.id_type = buckets, [], [], 0, "bigint"
        if path and exists(spark, f"{path}/state"):
            self._open()

    def _open(self) -> None:
        """The newest state that was written whole."""
        newest = self.spark.read.parquet(f"{self.path}/state").orderBy(F.desc("version")).first()
        held = json.loads(newest["state"])
        self.buckets, self.runs, self.heavy, self.batches, self.id_type = (held[k] for k in ("buckets", "runs", "heavy", "batches", "id_type"))
        for name in self.runs:
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (anchor BIGINT, around BIGINT, check INT, key BIGINT, doc_id {self.id_type}, place BIGINT, batch INT, slot INT) USING parquet "
                f"CLUSTERED BY (anchor, slot) SORTED BY (anchor, slot) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'"
            )

    def _save(self) -> None:
        state = json.dumps({"buckets": self.buckets, "runs": self.runs, "heavy": self.heavy, "batches": self.batches, "id_type": self.id_type})
        version = 1
        if exists(self.spark, f"{self.path}/state"):
            version += self.spark.read.parquet(f"{self.path}/state").agg(F.max("version")).first()[0]
        row = self.spark.range(1).select(F.lit(version).cast("long").alias("version"), F.lit(state).alias("state"))
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/state")

    def append(self, rows: DataFrame) -> DataFrame:
        """``rows`` is read twice: a written table, or cheap to compute. Returns the run, numbered as the next batch."""
        self.batches += 1
        self._write(rows.withColumn("batch", F.lit(self.batches)))
        return self.spark.table(self.runs[-1])

    def _write(self, rows: DataFrame) -> None:
        name = f"run_{uuid.uuid4().hex}"
        self.id_type = rows.schema["doc_id"].dataType.simpleString()
        self.heavy = sorted({*self.heavy, *heavy(rows, "anchor", max(LEAST_PARTS, 4 * self.buckets))})
        slot = F.when(F.col("anchor").isin(self.heavy), F.pmod(F.col("key"), F.lit(SLOTS))).otherwise(-1)
        (
            rows.withColumn("slot", slot.cast("int"))
            .repartition(self.buckets, "anchor", "slot")
            .write.format("parquet")
            .option("path", f"{self.path}/{name}")
            .option("compression", "zstd")
            .bucketBy(self.buckets, "anchor", "slot")
            .sortBy("anchor", "slot")
            .saveAsTable(name)
        )
        self.runs.append(name)
        self._save()

    def rows(self) -> DataFrame:
        """All runs; they have equal buckets, so what goes by anchor and slot needs no shuffle."""
        out = self.spark.table(self.runs[0])
        for name in self.runs[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def compact(self) -> None:
        """Write all runs as one; the old ones stay until the new one is whole."""
        old = self.runs
        if len(old) < 2:
            return
        rows = self.rows()
        self.runs, self.heavy = [], []
        self._write(rows.drop("slot"))
        for name in old:
            self.spark.sql(f"DROP TABLE {name}")
            removed(self.spark, f"{self.path}/{name}")


def _marks(index: FingerprintIndex) -> DataFrame:
    """key, doc_id, new, place, seen: anchors whose windows all occurred before (seen) or may have.

    An anchor occurred before where the first of its neighbourhood lies earlier;
    rows that repeat lie at the same place, so neither comes before the other.
    """
    rows, heavy_anchors = index.rows(), index.heavy
    at = F.struct("batch", F.col("doc_id").isNull().alias("no_id"), "doc_id", "place")
    is_heavy = F.col("anchor").isin(heavy_anchors)
    by_anchor = Window.partitionBy("anchor", "slot")
    order = ["around", "check", "batch", F.col("doc_id").asc_nulls_last(), "place"]
    sorted_by = by_anchor.orderBy(*order)
    alike = Window.partitionBy("anchor", "slot", "around", "check").orderBy("batch", F.col("doc_id").asc_nulls_last(), "place")
    # columns made before the first window would hide the buckets of the union
    shown = ["key", "doc_id", (F.col("batch") == index.batches).alias("new"), "place", "seen"]
    stepped = (
        rows.where(~is_heavy)
        .withColumn("before", F.lag("around").over(sorted_by))
        .withColumn("after", F.lead("around").over(sorted_by))
        .where("before IS NOT NULL OR after IS NOT NULL")
        .withColumn("seen", at > F.first(at).over(alike))
    )
    kinds = F.sum((~F.col("seen")).cast("int")).over(by_anchor)
    light = stepped.withColumn("kinds", kinds).where("seen OR kinds > 1").select(*shown)
    if not heavy_anchors:
        return light
    # a slot tells all but its own first row of a neighbourhood; those few are then told from the least of them
    crowd = rows.where(is_heavy).withColumn("seen", at > F.first(at).over(alike))
    same, leads = ["anchor", "around", "check"], crowd.where("NOT seen").drop("seen")
    first = leads.groupBy(*same).agg(F.min(at).alias("first"))
    told = leads.join(first, same).withColumn("seen", at > F.col("first"))
    return light.unionByName(crowd.where("seen").select(*shown)).unionByName(told.select(*shown))


def _window_rows(texts: DataFrame) -> DataFrame:
    """h1, h2, new, key, doc_id, start of the windows of the places that may have occurred before."""
    long = T.LongType()
    schema = T.StructType([T.StructField("h1", long), T.StructField("h2", T.IntegerType()), T.StructField("new", T.BooleanType()), T.StructField("key", long), texts.schema["doc_id"], T.StructField("start", long)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            keys, ids, new, places = (batch.column(k) for k in (0, 1, 3, 4))
            for cut in slabs(pc.binary_length(batch.column(2)).to_pylist()):
                chosen, local, rows, held, base = [], [], [], [], 0
                for row, (body, spots) in enumerate(zip(batch.column(2)[cut].to_pylist(), places[cut].to_pylist())):
                    low, high = _windows_of(np.array(spots, dtype=np.int64))
                    at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]))
                    need = np.unique(at[:, None] + np.arange(SPAN))  # words of these windows; no others are hashed
                    words = expand(body).split()
                    held.append(b" ".join([words[k] for k in need.tolist()]))
                    chosen.append(at)
                    local.append(base + np.searchsorted(need, at))
                    rows.append(np.full(len(at), row))
                    base += len(need)
                words, _ = word_hashes(held)
                at, row, start = np.concatenate(local), np.concatenate(rows), np.concatenate(chosen)
                second = sequence_hashes(mixed(words), SPAN)[at] >> np.uint64(32)
                of = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sequence_hashes(words, SPAN)[at].view(np.int64)),
                        pa.array(second.astype(np.uint32).view(np.int32)),
                        new[cut].take(of),
                        keys[cut].take(of),
                        ids[cut].take(of),
                        pa.array(start),
                    ],
                    names=[f.name for f in schema.fields],
                )

    return texts.select("key", "doc_id", "text", "new", "places").mapInArrow(run, schema)


def _removed(texts: DataFrame, with_text: bool) -> DataFrame:
    """Every document with its counts and the digest of the words that stay, and, if asked, those words."""
    fields = [texts.schema["doc_id"]] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept_text", T.StringType())] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, bodies, marked, alone = (batch.column(k) for k in range(4))
            for cut in slabs(pc.binary_length(bodies).to_pylist()):
                n_words, n_removed, shas, texts = [], [], [], []
                for body, seen, starts in zip(*(c[cut].to_pylist() for c in (bodies, marked, alone))):
                    words = expand(body).split()
                    n = 0
                    if seen or starts:
                        low, high = _windows_of(np.array(seen or [], dtype=np.int64))
                        single = np.array(starts or [], dtype=np.int64)
                        steps = np.zeros(len(words) + 1, dtype=np.int64)
                        np.add.at(steps, np.minimum(np.concatenate([low, single]), len(words)), 1)
                        np.add.at(steps, np.minimum(np.concatenate([high, single]) + SPAN, len(words)), -1)
                        gone = np.cumsum(steps)[:-1] > 0
                        n = int(gone.sum())
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    kept = b" ".join(words)
                    n_words.append(len(words) + n)
                    n_removed.append(n)
                    shas.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8"))
                columns = [ids[cut], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.string())] * with_text, names=[f.name for f in fields])

    return texts.mapInArrow(run, T.StructType(fields))


def deduplicated(
    docs: DataFrame, index: FingerprintIndex | None = None, history: DataFrame | None = None, with_text: bool = True
) -> DataFrame:
    """``docs`` cut by what they or the index's runs hold; appends their run.

    Returns doc_id, n_words, n_removed, kept_sha256 and, if asked, kept_text of every row.
    ``history`` has the documents of the older runs (doc_id, text), read only
    where an anchor of theirs is met again in other words; an index that has
    runs needs it.
    """
    index = index or FingerprintIndex(docs.sparkSession, buckets=buckets_for(docs))
    if index.runs and history is None:
        raise ValueError("the index has runs: their documents are needed as history")
    index.append(anchors(plain(docs)))
    marks = _marks(index)
    new = packed(docs)
    by_doc = marks.groupBy("key", "doc_id", "new").agg(
        F.collect_list(F.when(~F.col("seen"), F.col("place"))).alias("places"), F.collect_list(F.when(F.col("seen"), F.col("place"))).alias("seen")
    )
    by_doc = written(by_doc, "marks")
    unsure = by_doc.where(F.size("places") > 0)
    shown = ["text", "new", "places"]

    def met(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        return rows.join(wanted, same_row(rows, wanted)).select(rows["key"], rows["doc_id"], *shown)

    texts = met(new, unsure.where("new"))
    if history is not None:
        texts = texts.unionByName(met(packed(history), unsure.where("NOT new")))
    rows = _window_rows(texts)
    at = F.struct("new", F.col("doc_id").isNull().alias("no_id"), "doc_id", "start")
    first = rows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = rows.join(first, ["h1", "h2"]).where(F.col("new") & (at > F.col("first")))
    starts = later.groupBy("key", "doc_id").agg(F.collect_set("start").alias("starts"))
    seen = by_doc.where("new").select("key", "doc_id", "seen")
    joined = new.join(seen, same_row(new, seen), "left").select(new["key"], new["doc_id"], "text", "seen")
    joined = joined.join(starts, same_row(joined, starts), "left").select(joined["doc_id"], "text", "seen", "starts")
    return _removed(joined, with_text)


def deduplicated_in_batches(docs: DataFrame, batches: int = 2, with_text: bool = True) -> DataFrame:
    """``docs`` cut in batches of ascending doc_id, as days of a crawl would come: each against the runs before it. At the end the runs are compacted to one."""
    index = FingerprintIndex(docs.sparkSession, buckets=buckets_for(docs))
    out = before = None
    for batch in cut_by_id(docs, batches):
        part = written(deduplicated(batch, index, before, with_text), "kept")
        out = part if out is None else out.unionByName(part)
        before = batch if before is None else before.unionByName(batch)
    index.compact()
    return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated_in_batches(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, list_aggregate(w[i : i + 19], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM dup, range(20) r(k)
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
