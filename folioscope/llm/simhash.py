"""SimHash near-duplicates through Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ
in at most two bits agree wholly on some segment and differ in at most one bit
on the segment after it (going round), so each fingerprint is filed under that
segment's bits joined with a Golay codeword index of the next segment, padded
to 23 bits. The perfect (23,12) code puts every vector within three bits of one
codeword; vectors three bits away are filed under the five codewords four bits
away as well, and then vectors one bit apart always share an index. Candidates
under one key are verified by counting differing bits.

Only different fingerprints are filed, so copies cost nothing. A key with more
than ``CROWD`` fingerprints is not paired: its members are filed again under
their bits with two of the bits outside the exact segment blanked. Members of such a key
differ in at most two bits by construction, and each is linked to the key's
smallest, so the links grow with the members and none is lost.

Defined results: a null or empty text has the fingerprint zero and links like
any other; rows that repeat link to each other, and ``keep_one`` keeps one of them; an empty table gives no rows;
with a null doc_id, the component is named by its smallest known id (null where there is none);
ids may be of any ordered type; columns of any name are kept as they are; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, one_of_each, own_row, text_or_empty, written
from .components import components

SEED, SHINGLE, MOST_BITS = 42, 3, 2
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
CROWD = 400
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the (23,12,7) code.
GENERATOR = 0b110001110101
#: Hashes that are unpacked to bits at once.
SLAB = 1 << 16


def shingle_hashes(text: str) -> list[int]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() and split() know ASCII alone
    if not words:
        return []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        return [digest(join(words), SEED)]
    return [digest(join(t), SEED) for t in zip(words, words[1:], words[2:])]


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), SLAB):
        bits = np.unpackbits(hashes[k : k + SLAB].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    set_bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed long, for every row."""
    schema = docs.select("doc_id").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(np.array(shingle_hashes(t), dtype=np.uint64)) for t in batch.column(1).to_pylist()]
            held = pa.array(np.array(fps, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), held], names=["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, schema)


def remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit polynomials by the generator: the syndrome."""
    out = words.astype(np.int64)
    for bit in range(22, 10, -1):
        out = np.where((out >> bit) & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def error_patterns() -> np.ndarray:
    """For each syndrome, the errors of up to three bits, and of four where it takes three; padded to six by repeating."""
    ones = np.array([1 << i for i in range(23)], dtype=np.int64)
    level, by = np.zeros(1, dtype=np.int64), {}
    for weight in range(5):
        for pattern, syndrome in zip(level, remainder(level)):
            held = by.setdefault(int(syndrome), [])
            if not held or (weight == 4 and bin(held[0]).count("1") == 3):
                held.append(int(pattern))
        # add a bit above the highest set
        level = np.unique(np.concatenate([level[level < one] | one for one in ones]))
    return np.array([(p := by[s]) + [p[0]] * (6 - len(p)) for s in range(1 << 11)], dtype=np.int64)


def indices(words: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words; repeats where there are fewer."""
    return (words[:, None] ^ patterns[remainder(words)]) >> 11


def keys_of(fps: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (position in fps, key) of distinct keys; a key names its segment in its top bits."""
    rows, keys = [], []
    for k, (low, width) in enumerate(SEGMENTS):
        low2, width2 = SEGMENTS[(k + 1) % 3]
        exact = ((fps >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64)
        near = ((fps >> np.uint64(low2)) & np.uint64((1 << width2) - 1)).astype(np.int64)
        found = np.sort(indices(near, patterns), axis=1)
        fresh = np.ones_like(found, dtype=bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        at, column = np.nonzero(fresh)
        rows.append(at)
        keys.append((k << 36) | (exact[at] << 12) | found[at, column])
    return np.concatenate(rows), np.concatenate(keys)


def filed(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = error_patterns()
        for batch in batches:
            fps = batch.column(0).to_numpy()
            rows, keys = keys_of(fps.view(np.uint64), patterns)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], names=["key", "fp"])

    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def crowded_links(crowd: DataFrame) -> DataFrame:
    """Links among the members (key, fp) of crowded keys: star edges, no pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            segment, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for k, (low, width) in enumerate(SEGMENTS):
                held = fps[segment == k].view(np.uint64)
                free = [b for b in range(64) if not low <= b < low + width]
                masks = [(i, j) for n, i in enumerate(free) for j in free[n + 1 :]]
                blank = np.array([~((1 << i) | (1 << j)) & (2**64 - 1) for i, j in masks], dtype=np.uint64)
                name = np.array([64 * i + j for i, j in masks], dtype=np.int64)
                for part in np.array_split(held, len(held) // 200 + 1):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.tile(name, len(part))),
                            pa.array((part[:, None] & blank).ravel().view(np.int64)),
                            pa.array(np.repeat(part, len(name)).view(np.int64)),
                        ],
                        names=["mask", "held", "fp"],
                    )

    segments = crowd.select(F.expr("shiftright(key, 36)").alias("segment"), "fp").distinct()
    blanked = segments.mapInArrow(run, "mask long, held long, fp long")
    centre = blanked.groupBy("mask", "held").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top <> b")
    return blanked.join(centre, ["mask", "held"]).where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints; within crowded keys those of a spanning set."""
    keyed = filed(nodes)
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(keyed.join(sizes, "key"), "keys")
    few = shared.where(F.col("n") <= CROWD).select("key", "fp")
    other = few.select("key", F.col("fp").alias("fp2"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= MOST_BITS
    pairs = few.join(other, "key").where((F.col("fp") > F.col("fp2")) & close)
    out = pairs.select(F.col("fp").alias("a"), F.col("fp2").alias("b"))
    crowd = shared.where(F.col("n") > CROWD)
    return out.union(crowded_links(crowd)) if not crowd.isEmpty() else out


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component (a fingerprint) and component_id of every row."""
    prints = written(fingerprints(docs), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = written(components(links(nodes)), "components")
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "component").select("fp", "component", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component", "component_id")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    return _grouped(docs).drop("component")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns stay.

    Rows are told from a table of the ids that go, so texts are shuffled only
    where that table is too large for Spark to broadcast. Where several rows have
    an id that stays, these rows alone are told by their own texts: one stays of each group that the id names.
    """
    found = written(_grouped(docs), "groups")
    named = found.select(F.col("component_id").alias("named")).distinct()
    is_named = F.col("doc_id").eqNullSafe(F.col("named"))
    gone = written(found.join(named, is_named, "left_anti").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    again = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(named, is_named, "left_semi")
    again = written(again.select(F.col("doc_id").alias("again_id")), "again")
    kept = docs.select(own_row(docs)).join(gone, F.col("row.doc_id").eqNullSafe(F.col("gone_id")), "left_anti")
    if again.isEmpty():
        return kept.select("row.*")
    repeats = F.col("row.doc_id").eqNullSafe(F.col("again_id"))
    many = kept.join(again, repeats, "left_semi")
    told = fingerprints(many.select(F.col("row").alias("doc_id"), F.col("row.text").alias("text"))).withColumnRenamed("doc_id", "row")
    groups = found.select("fp", "component", "component_id").distinct()
    stay = told.join(groups, "fp").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    return kept.join(again, repeats, "left_anti").select("row.*").unionByName(one_of_each(stay, "component"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
