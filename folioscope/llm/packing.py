"""Hierarchical packing: documents into windows of several context sizes, without padding.

A document is its token ids and an end mark. What fills whole windows of the
longest size is cut off and is a sequence as it stands; the rest is routed to
the smallest size (tier) that holds it. Tiers are packed from the longest down:
a window begins with the longest piece there is and its gap is filled from the
shorter tiers, always with the longest piece that still fits; where none fits,
the shortest one is cut and its rest is routed anew. A window is begun only when
there are tokens enough to fill it, so every window is full. What is left at a
task's end fills windows of descending powers of two.

A task packs its own rows, so texts are not shuffled, and holds the ids of one
slab of texts and less than one window from slab to slab. Tasks number their
windows by size; sequence ids count on from the tasks before, by a table of one row per
task and size. Sequences in order of falling size make one line of tokens, which is
cut into step groups of equal length: a training step then meets one window
size, except where sizes meet, and steps differ by less than a window.

Defined results: a null or empty text is the end mark alone; rows that repeat
are packed each for itself; further columns are not looked at, whatever their
names; ids may be of any type; a very long text is encoded in stretches and
its windows are handed on in one go; an empty table gives no rows. Which documents meet in a window depends on
how the input is split, the number of tokens and the lack of padding do not.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer as Library
from tokenizers import normalizers, pre_tokenizers

from .bpe import STRETCH, default_path
from .common import documents, slabs, text_or_empty, written

#: Context sizes; the id that ends a document; tokens of a training step, about.
TIERS, END, STEP_TOKENS = (256, 512, 1024, 2048, 4096), 2, 1 << 20
#: Bytes of text whose ids a task holds at once.
SLAB = 12 << 20
#: Bytes of an id.
WIDE = 4
#: Words that a task remembers, in each of two generations, and those that are one text for the library.
KEPT_WORDS, LOT = 500_000, 100


class Encoder:
    """Ids by the tokenizers library, for vocabularies that read words between white space by themselves.

    Words are runs of anything but ASCII white space. Different ones of a slab are told
    apart by Arrow, each is encoded once and remembered, and the texts' ids are
    put together from those of their words all at once. New words go to the
    library in lots. Printable ASCII words, which normalise to their lower case,
    go as the pieces that the vocabulary's own pattern cuts them into; tokens
    that end a piece tell where a word ends. Others go with a word between them that is one
    token of its own, and words that hold this one or a special token as texts by themselves.
    """

    BETWEEN = "\x00"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Library.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        between = self.library.encode(self.BETWEEN, add_special_tokens=False).ids
        if len(between) != 1:
            raise ValueError("the vocabulary has no token for the word between words")
        self.between = between[0]
        self.odd = re.compile("|".join(map(re.escape, [self.BETWEEN, *(t.content for t in self.library.get_added_tokens_decoder().values())])))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.blank = re.compile("[ \\t-\\r]+")
        held = json.loads(self.library.to_str())
        self.cut = regex.compile(held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "| ")
        suffix, vocabulary = held["model"]["end_of_word_suffix"], self.library.get_vocab()
        self.ends_piece = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_piece[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.of_pieces = Library.from_file(path)
        self.of_pieces.normalizer, self.of_pieces.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()

    def _ids(self, of: Library, texts: list[str]) -> np.ndarray:
        """Of texts together; short ones, as the library's time per character grows with a text."""
        return np.array(list(chain.from_iterable(e.ids for e in of.encode_batch_fast(texts, add_special_tokens=False))), "<u4")

    def keep(self, words: list[str], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        cuts = map(slice, (starts * WIDE).tolist(), (ends * WIDE).tolist())
        self.words.update(zip(words, map(ids.tobytes().__getitem__, cuts)))

    def learn(self, words: list[str]) -> None:
        some_odd = self.odd.search(" ".join(words))
        odd = {w for w in words if self.odd.search(w)} if some_odd else set()
        for word in odd:
            self.keep([word], ids := self._ids(self.library, [word]), np.zeros(1, np.int64), np.array([len(ids)]))
        plain = [w for w in words if w.isascii() and w.isprintable() and w not in odd]
        if plain:
            cut = self.cut.findall(" ".join(plain).lower())
            pieces = [c for c in cut if c != " "]
            ids = self._ids(self.of_pieces, [" ".join(pieces[k : k + LOT]) for k in range(0, len(pieces), LOT)])
            between = np.flatnonzero(np.fromiter(map(" ".__eq__, cut), bool, len(cut)))
            last = np.append(between - np.arange(len(between)), len(pieces)) - 1  # of each word's pieces
            ends = np.flatnonzero(self.ends_piece[ids])[last] + 1
            self.keep(plain, ids, np.append(0, ends[:-1]), ends)
        rest = [w for w in words if not (w.isascii() and w.isprintable()) and w not in odd]
        if rest:
            mark = f" {self.BETWEEN} "
            ids = self._ids(self.library, [mark.join(rest[k : k + LOT]) + mark for k in range(0, len(rest), LOT)])
            ends = np.flatnonzero(ids == self.between)
            self.keep(rest, ids, np.append(0, ends[:-1] + 1), ends)

    def ids_of(self, words: list[str]) -> list[bytes]:
        if len(self.words) > KEPT_WORDS:
            self.older, self.words = self.words, {}
        self.words[""] = b""  # what stands before leading white space, and all of an empty text
        found = list(map(self.words.get, words))
        lacking = [k for k, held in enumerate(found) if held is None]
        if lacking:
            again = list(map(self.older.get, map(words.__getitem__, lacking)))
            self.words.update((words[k], held) for k, held in zip(lacking, again) if held is not None)
            self.learn([words[k] for k, held in zip(lacking, again) if held is None])
            for k in lacking:
                found[k] = self.words[words[k]]
        return found

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers."""
        lists = pc.ascii_split_whitespace(texts)
        told = lists.flatten().dictionary_encode()
        words, nth = told.dictionary.to_numpy(zero_copy_only=False).tolist(), told.indices.to_numpy()
        held = self.ids_of(words)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // WIDE
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(held), "<u4")
        size = sizes[nth]
        ends = np.cumsum(size)
        at = np.repeat(starts[nth] - ends + size, size)
        at += np.arange(len(at))
        raw, bounds = flat[at].tobytes(), np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * WIDE
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def stretches(self, text: str) -> Iterator[str]:
        """A text in stretches of about ``STRETCH`` characters, cut at white space."""
        low = 0
        while len(text) - low > 2 * STRETCH:
            found = self.blank.search(text, low + STRETCH)
            if not found:
                break
            yield text[low : found.end()]
            low = found.end()
        yield text[low:]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker process: what it remembers stays between tasks."""
    return Encoder(path)


class Piece:
    """Some ids of a document: ``start`` and ``length`` count ids, ``ids`` are little-endian 32-bit numbers."""

    __slots__ = ("doc", "start", "length", "ids")

    def __init__(self, doc: tuple, start: int, ids: bytes):
        self.doc, self.start, self.length, self.ids = doc, start, len(ids) // WIDE, ids

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[: length * WIDE]), Piece(self.doc, self.start + length, self.ids[length * WIDE :])


class Pool:
    """Pieces that wait for a window, by length."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.held = sorted(tiers), 0
        self.by_length: list[deque[Piece]] = [deque() for _ in range(self.tiers[-1] + 1)]
        self.there = 0  # bit n is set while there is a piece of n ids

    def add(self, piece: Piece) -> None:
        self.by_length[piece.length].append(piece)
        self.there |= 1 << piece.length
        self.held += piece.length

    def take(self, length: int) -> Piece:
        pieces = self.by_length[length]
        piece = pieces.popleft()
        if not pieces:
            self.there ^= 1 << length
        self.held -= length
        return piece

    def filling(self, gap: int) -> Piece:
        """The longest piece that fits, or what is cut from the shortest."""
        fits = self.there & ((2 << gap) - 1)
        if fits:
            return self.take(fits.bit_length() - 1)
        piece, rest = self.take((self.there & -self.there).bit_length() - 1).cut(gap)
        self.add(rest)
        return piece

    def windows(self, last: bool = False) -> Iterator[list[Piece]]:
        """Full windows, as long as there are tokens for the next one; at the end, of whatever power of two is left."""
        while self.there:
            longest = self.there.bit_length() - 1
            size = next(t for t in self.tiers if t >= longest)
            if self.held < size:
                if not last:
                    return
                size = 1 << (self.held.bit_length() - 1)
            window, gap = [], size
            while gap:
                piece = self.filling(gap)
                window.append(piece)
                gap -= piece.length
            yield window


def id_stretches(tok: Encoder, texts: pa.Array) -> Iterator[Iterable[bytes]]:
    """For each text its ids, long texts stretch by stretch."""
    long = pc.greater(pc.binary_length(texts), 2 * STRETCH)
    ready = iter(tok.encode(texts.filter(pc.invert(long))))
    for text, is_long in zip(texts, long.to_pylist()):
        yield (tok.encode(pa.array([s]))[0] for s in tok.stretches(text.as_py())) if is_long else (next(ready),)


def whole_windows(stretches: Iterable[bytes], end: int, most: int) -> tuple[list[tuple[int, bytes, int]], bytes, int]:
    """Of one document: the windows of ``most`` ids that it fills alone (start, ids, checksum), the ids left, and how many there are in all."""
    full: list[tuple[int, bytes, int]] = []
    held, start, wide = b"", 0, most * WIDE
    for raw in chain(stretches, (end.to_bytes(WIDE, "little"),)):
        held += raw
        low = 0
        while len(held) - low >= wide:
            ids = held[low : low + wide]
            full.append((start, ids, crc32(ids)))
            start, low = start + most, low + wide
        held = held[low:]
    return full, held, start + len(held) // WIDE


class Task:
    """The windows of one task as columns of rows, one a piece."""

    def __init__(self, tiers: tuple[int, ...], end: int):
        self.pool, self.end, self.numbers = Pool(tiers), end, Counter()
        self.rows: list[tuple] = []

    def put(self, window: list[Piece]) -> None:
        size = sum(p.length for p in window)
        nth, offset = self.numbers[size], 0
        self.numbers[size] += 1
        for p in window:
            self.rows.append((p.doc[0], p.start, p.length, crc32(p.ids), p.doc[1], size, nth, offset, p.ids))
            offset += p.length

    def feed(self, ids: list, texts: pa.Array, tok: Encoder) -> None:
        most = self.pool.tiers[-1]
        for doc, stretches in zip(ids, id_stretches(tok, texts)):
            full, rest, n = whole_windows(stretches, self.end, most)
            told = (doc, n)
            for start, held, checksum in full:
                self.rows.append((doc, start, most, checksum, n, most, self.numbers[most], 0, held))
                self.numbers[most] += 1
            if rest:
                self.pool.add(Piece(told, n - len(rest) // WIDE, rest))
        for window in self.pool.windows():
            self.put(window)

    def finish(self) -> None:
        for window in self.pool.windows(last=True):
            self.put(window)

    def batch(self, schema: pa.Schema, part: int) -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*(r[:8] for r in self.rows)), schema)]
        if "ids" in schema.names:
            ends = np.concatenate([[0], np.cumsum([r[2] for r in self.rows])]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(r[8] for r in self.rows), dtype="<i4"))))
        columns.append(pa.array(np.full(len(self.rows), part, np.int64)))
        self.rows = []
        return pa.RecordBatch.from_arrays(columns, names=schema.names)


def pieces(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece, its window named by task, size and number."""
    path = path or default_path()
    longs = ("start", "length", "ids_crc32", "doc_tokens", "size", "nth", "offset")
    fields = [docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in longs)]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("task", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, task, part, schema = encoder(path), Task(tiers, end), 0, None
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1)
            if not len(doc):
                continue
            part = batch.column(2)[0].as_py()
            kinds = [pa.field("doc_id", doc.type), *(pa.field(c, pa.int64()) for c in longs)]
            schema = pa.schema(kinds + [pa.field("ids", pa.list_(pa.int32()))] * with_ids + [pa.field("task", pa.int64())])
            for cut in slabs(pc.binary_length(texts).to_pylist(), SLAB):
                task.feed(doc[cut].to_pylist(), texts[cut], tok)
                if task.rows:
                    yield task.batch(schema, part)
        task.finish()
        if task.rows:
            yield task.batch(schema, part)

    rows = docs.select("doc_id", text_or_empty().alias("text"), F.spark_partition_id().alias("task"))
    return rows.mapInArrow(run, T.StructType(fields))


def numbered(found: DataFrame, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """``found`` (a written table of pieces) with sequence_id and step_group; sequences count from the longest size down."""
    each = found.groupBy("size", "task").agg((F.max("nth") + 1).alias("windows"))
    by_task = Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = written(each.withColumn("earlier", F.coalesce(F.sum("windows").over(by_task), F.lit(0))), "packing-tasks")
    # one row per size, a power of two
    longer = Window.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    sizes = tasks.groupBy("size").agg(F.sum("windows").alias("n")).select(
        "size",
        F.coalesce(F.sum("n").over(longer), F.lit(0)).alias("first_id"),
        F.coalesce(F.sum(F.col("n") * F.col("size")).over(longer), F.lit(0)).alias("first_token"),
        F.sum(F.col("n") * F.col("size")).over(Window.partitionBy()).alias("tokens"),
    )
    shifts = written(tasks.join(sizes, "size").drop("windows"), "packing-shifts")
    nth = F.col("earlier") + F.col("nth")
    steps = F.greatest(F.round(F.col("tokens") / step_tokens), F.lit(1))
    step = F.floor((F.col("first_token") + nth * F.col("size")) / F.col("tokens") * steps)
    met = found.join(shifts, ["size", "task"])
    return met.withColumn("sequence_id", F.col("first_id") + nth).withColumn("step_group", step.cast("long")).drop("nth", "task", "earlier", "first_id", "first_token", "tokens")


def packed(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end: int = END, step_tokens: int = STEP_TOKENS, with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence, its place there, the sequence's size and its step group, and if asked its ids."""
    return numbered(written(pieces(docs, path, tiers, end, with_ids), "packing-pieces"), step_tokens)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "size", "step_group"
    )
