"""Scoring documents with a gated recurrent language model over corpus counts.

Counts of all training tokens are a Spark aggregation, combined in each batch
before the shuffle. Documents are dealt into blocks of about ``BLOCK_BYTES``;
a block's distinct tokens are joined with the counts and brought back to the
block, so no vocabulary is held whole anywhere. Class probabilities, tail distributions
and the smoothed unigram score use those counts over all training documents.

The recurrent weights start from one block's training documents, in a task.
From there every partition of the input trains its own copy on all words of all
its training documents, a block at a time, and the copies are averaged by their
words. A state begins anew with each document, in training as in scoring.

Defined results: a null or empty text is the end token alone; a null doc_id is
taken as the empty string for the split; ids may be of any type that casts to
text; rows that repeat score alike; further columns are not looked at; a very
long text is scored whole, its state carried from window to window; with no
training document, counts are zero and the score is that of the smoothed
unigram; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slabs, text_or_empty, written
from .gru import Gru

#: No word has white space, so this is none.
END = b"\n"
ADD = 0.1
HEAD_WORDS, HEAD_CLASSES, TAIL_CLASSES, HIDDEN = 1024, 24, 24, 16
BLOCK_BYTES = 24_000_000
#: Words over which errors are carried back.
STEPS = 32
#: Rows that a copy trains side by side: fewer where few words would make too few updates.
LANES, LEAST_LANES, LEAST_UPDATES = 256, 8, 64


def tail_class(token: bytes) -> int:
    """Rare words are classed by how they end."""
    return zlib.crc32(token[-2:]) % TAIL_CLASSES


@lru_cache(maxsize=1)
def ending_classes() -> np.ndarray:
    """The tail class by the last two bytes, then by the only byte of tokens that have one."""
    two = [tail_class(bytes((a, b))) for a in range(256) for b in range(256)]
    return np.array(two + [tail_class(bytes((b,))) for b in range(256)], dtype=np.int64)


def tail_classes(tokens: pa.Array) -> np.ndarray:
    """The tail class of each of ``tokens``, none empty, from the bytes where they end."""
    _, offsets, data = tokens.buffers()
    ends = np.frombuffer(offsets, np.int32)[tokens.offset : tokens.offset + len(tokens) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8).astype(np.int64) if data else np.zeros(1, np.int64)
    last = held[ends[1:] - 1]
    return ending_classes()[np.where(np.diff(ends) > 1, held[ends[1:] - 2] * 256 + last, 65536 + last)]


def numbers_of(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of the texts (bytes), the number of each token in order, and where each text starts (one more than texts).

    Arrow cuts the words and numbers them, so no token is an object of Python's.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    # of bytes: ASCII alone is lowered, and white space is ASCII's
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
    held = cut.flatten().dictionary_encode()
    words, numbers = held.dictionary, held.indices.to_numpy()
    # white space at either end leaves an empty word
    empty = pc.index(words, "").as_py()
    real = np.ones(len(numbers), dtype=bool) if empty < 0 else numbers != empty
    starts = np.concatenate([[0], np.cumsum(real)])[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
    numbers = numbers[real]
    if empty >= 0:
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
        numbers = numbers - (numbers > empty)
    end = len(words)
    tokens = pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())])
    return tokens, np.insert(numbers, starts[1:], end), starts + np.arange(len(starts))


def together(parts: list[pa.Array]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct tokens of the parts, as they come, and for each part their numbers."""
    held = pa.chunked_array(parts).dictionary_encode().unify_dictionaries()
    return held.chunk(0).dictionary, [chunk.indices.to_numpy() for chunk in held.chunks]


@dataclass
class Model:
    gru: Gru | None
    head: dict[bytes, int]  # to the word's number, words of a class together
    class_of: np.ndarray
    tail_n: np.ndarray
    tail_v: np.ndarray
    n: int
    v: int

    def numbered(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Class and head word (-1 in tails) of distinct tokens."""
        found = pc.index_in(tokens, value_set=pa.array(list(self.head), pa.binary()))
        word = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        tail = tail_classes(tokens) + HEAD_CLASSES
        return np.where(word >= 0, self.class_of[np.maximum(word, 0)] if len(self.class_of) else 0, tail), word

    def sequences(self, at: np.ndarray, starts: np.ndarray, classes: np.ndarray, words: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text inputs (each the token before, first the start), target classes and target words."""
        c, w = classes.astype(np.int16)[at], words.astype(np.int16)[at]
        k = len(self.class_of)
        shown = np.empty_like(w)
        shown[1:] = np.where(w >= 0, w, c + (k - HEAD_CLASSES))[:-1]
        shown[starts[:-1]] = k + TAIL_CLASSES
        return [(shown[a:b], c[a:b], w[a:b]) for a, b in zip(starts, starts[1:])]


def split(docs: DataFrame) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        "doc_id", (F.pmod(crc, F.lit(10)) == 0).alias("held_out"), text_or_empty().cast("binary").alias("text")
    )


def counted(rows: DataFrame) -> DataFrame:
    """token, c over the training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.binary_length(batch.column(0)).to_pylist()
            for wide in slabs(lengths, 8 << 20):
                held, parts, counts = batch.column(0)[wide], [], []
                for cut in slabs(lengths[wide]):
                    tokens, numbers, _ = numbers_of(held[cut])
                    parts.append(tokens)
                    counts.append(np.bincount(numbers, minlength=len(tokens)))
                tokens, places = together(parts)
                c = np.bincount(np.concatenate(places), weights=np.concatenate(counts), minlength=len(tokens))
                yield pa.RecordBatch.from_arrays([tokens, pa.array(c.astype(np.int64))], names=["token", "c"])

    parts = rows.where("NOT held_out").select("text").mapInArrow(run, "token binary, c long")
    return parts.groupBy("token").agg(F.sum("c").alias("c"))


def fresh(counts: DataFrame) -> Model:
    """The model of the counts, with a network that has learnt nothing yet."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "token").limit(HEAD_WORDS).collect()
    freq = np.array([r.c for r in top], dtype=np.float64)
    # classes of about equal mass, commonest words first
    mass = np.cumsum(freq) / freq.sum() if len(top) else freq
    class_of = np.minimum((mass - freq / (2 * max(1.0, freq.sum()))) * HEAD_CLASSES, HEAD_CLASSES - 1).astype(np.int64)
    bounds = np.searchsorted(class_of, np.arange(HEAD_CLASSES + 1))
    head = {bytes(r.token): n for n, r in enumerate(top)}
    tail_n, tail_v = np.zeros(TAIL_CLASSES), np.zeros(TAIL_CLASSES)
    ending = F.expr("substring(token, greatest(octet_length(token) - 1, 1), 2)")
    for r in counts.groupBy(F.pmod(F.crc32(ending), F.lit(TAIL_CLASSES)).alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tail_n[r.k], tail_v[r.k] = r.n, r.v
    for token, n in head.items():
        tail_n[tail_class(token)] -= freq[n]
        tail_v[tail_class(token)] -= 1
    model = Model(None, head, class_of, tail_n, tail_v, int(totals[0]), int(totals[1]))
    if not top:
        return model
    by_class = np.concatenate([np.bincount(class_of, weights=freq, minlength=HEAD_CLASSES), tail_n + ADD * (tail_v + 1)])
    inside = np.bincount(class_of, weights=freq, minlength=HEAD_CLASSES)[class_of]
    model.gru = Gru.fresh(bounds, TAIL_CLASSES, np.log(by_class + ADD) - math.log(by_class.sum()), np.log(freq / inside), HIDDEN, seed=7)
    return model


def trained(model: Model, rows: DataFrame, block_bytes: int, groups: int) -> Gru | None:
    """The network after each partition of ``rows`` (training documents) trained its copy on them, averaged by words; null where there are none.

    Copies are summed in ``groups`` before the driver takes them.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)
    schema = "part int, n long, weights binary"

    def row(part: int, n: int, weights: np.ndarray) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, part, n, texts, size = held.value, 0, 0, [], 0
        own = m.gru.copy()

        def learn() -> int:
            words = sum(len(text[0]) for text in texts)
            lanes = min(LANES, max(LEAST_LANES, words // (LEAST_UPDATES * STEPS)))
            own.train(texts, own.updates_for(words, lanes, STEPS), rows=lanes, steps=STEPS)
            texts.clear()
            return words

        for batch in batches:
            if not batch.num_rows:
                continue
            part, lengths = batch.column(1)[0].as_py(), pc.binary_length(batch.column(0)).to_pylist()
            for cut in slabs(lengths):
                distinct, numbers, starts = numbers_of(batch.column(0)[cut])
                texts += m.sequences(numbers, starts, *m.numbered(distinct))
                size += sum(lengths[cut])
                if size >= block_bytes:
                    n, size = n + learn(), 0
        if texts:
            n += learn()
        if n:
            yield from row(part, n, own.flat().astype(np.float64) * n).to_batches()

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("weights", "ascending")])  # sums depend on the order
        total = sum(np.frombuffer(w.as_py()) for w in table.column("weights"))
        return row(table.column("part")[0].as_py(), pc.sum(table.column("n")).as_py(), total)

    told = rows.select("text", F.pmod(F.spark_partition_id(), F.lit(groups)).alias("part"))
    sums = told.mapInArrow(train, schema).groupBy("part").applyInArrow(add, schema).collect()
    if not sums:
        return None
    sums = sorted(sums, key=lambda r: r["part"])
    return model.gru.copy(sum(np.frombuffer(r["weights"]) for r in sums) / sum(r["n"] for r in sums))


def scored(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Counts, smoothed unigram score and model score of every row."""
    spark = docs.sparkSession
    rows = split(docs)
    counts = written(counted(rows), "counts")
    model = fresh(counts)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    # by text too, so that rows of one id do not fill one block
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    if model.gru:
        learners = dealt.where("NOT held_out")
        # about one block, in one task: of fixed size
        model.gru = trained(model, learners.where("block = 0").repartition(1), block_bytes, 1) or model.gru
        model.gru = trained(model, learners, block_bytes, math.isqrt(blocks) + 1) or model.gru
    held = spark.sparkContext.broadcast(model)  # head words and weights only: of fixed size
    dealt = dealt.repartition(blocks, "block")

    def distinct(table: pa.Table) -> pa.Table:
        parts = [numbers_of(table.column("text")[cut])[0] for cut in slabs(pc.binary_length(table.column("text")).to_pylist())]
        out = pc.unique(pa.chunked_array(parts))
        return pa.table({"block": pa.repeat(table.column("block")[0], len(out)), "token": out})

    # broadcasting is left to Spark's own check of sizes
    known = dealt.groupBy("block").applyInArrow(distinct, "block int, token binary").join(counts, "token", "left").repartition(blocks, "block")
    fields = [docs.schema["doc_id"], T.StructField("held_out", T.BooleanType())]
    fields += [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")]
    fields += [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        m = held.value
        tokens = right.column("token").combine_chunks()
        c = np.nan_to_num(right.column("c").to_numpy().astype(np.float64))
        base = np.log10((c + ADD) / (m.n + ADD * (m.v + 1)))
        classes, words = m.numbered(tokens)
        tail = np.maximum(classes - HEAD_CLASSES, 0)
        inside = np.where(words >= 0, 0.0, np.log10((c + ADD) / (m.tail_n[tail] + ADD * (m.tail_v[tail] + 1))))
        cuts = [numbers_of(left.column("text")[cut]) for cut in slabs(pc.binary_length(left.column("text")).to_pylist())]
        # the joined tokens come first, so they keep their numbers
        _, (_, *places) = together([tokens, *(shown for shown, _, _ in cuts)])
        sums, texts = [], []
        for place in places:
            _, numbers, starts = cuts.pop(0)  # let go of as it is read
            at = place[numbers]
            sums.append([np.diff(starts), *(np.add.reduceat(x[at], starts[:-1]) for x in ((c > 0).astype(np.int64), base, inside))])
            if m.gru:
                texts += m.sequences(at, starts, classes, words)
        n, known_n, base_sum, inside_sum = (np.concatenate(x) for x in zip(*sums))
        model_sum = m.gru.score(texts) / math.log(10) + inside_sum if m.gru else base_sum
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n, pa.int64()),
            "n_known": pa.array(known_n, pa.int64()), "train_tokens": pa.repeat(pa.scalar(m.n, pa.int64()), len(n)),
            "base_score": pa.array(base_sum, pa.float64()), "score": pa.array(model_sum, pa.float64()),
        })

    return dealt.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, T.StructType(fields))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))
