"""Runs of repeated words in documents, told and collapsed.

Only stretches that may hold a long run are looked at closely. A run of period q
and length of at least ``LEAST_POWER`` q has so many neighbouring places equal to those q
before that one of them falls on a fixed grid; so for every q the places of the
grid are compared, and from those that agree, and agree beside, the stretch is extended both ways by hashes
of words. Equal words have equal hashes, so no run is lost; the stretches that
are left, with a word more at either side, go through ``tandem.runs``, which tells
words themselves apart, many stretches in one sequence with a letter of its own between.

Defined results: a null or empty text has no words and no runs; rows that
repeat are told alike; a null doc_id is not made periodic; further columns are
not looked at, whatever their names; ids may be of any type that casts to text; a
very long text is one sequence, held by one task as it is; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slabs, text_or_empty
from .passages import mixed
from .tandem import runs

#: Shortest runs that count: words, and periods.
LEAST_WORDS, LEAST_POWER = 6, 4
#: Bytes of text that a task takes apart at once, and words that go through ``tandem.runs`` together.
SLAB, CLOSE_WORDS = 8 << 20, 1 << 17


def made_periodic(doc_id: str | None, words: list[bytes]) -> list[bytes]:
    """The repetition that some documents are given, by their id."""
    if doc_id is None or not words:
        return words
    h, n = crc32(doc_id.encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


class Extender:
    """How far two places of a sequence agree, by hashes of stretches."""

    def __init__(self, hashes: np.ndarray):
        self.n = len(hashes)
        with np.errstate(over="ignore"):
            self.factor = np.full(self.n + 1, 0x9E3779B97F4A7C15, np.uint64)
            self.factor[0] = 1
            self.factor = np.cumprod(self.factor)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.factor[: self.n], dtype=np.uint64)])
        self.steps = [1 << k for k in reversed(range(self.n.bit_length()))]

    def same(self, a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[a + width] - self.sums[a]) * self.factor[b - a] == self.sums[b + width] - self.sums[b]

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a < b: how many places from these on agree."""
        out = np.zeros(len(a), np.int64)
        for step in self.steps:
            fits = np.flatnonzero(b + out + step <= self.n)
            out[fits] += step * self.same(a[fits] + out[fits], b[fits] + out[fits], step)
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For a < b: how many places before these agree."""
        out = np.zeros(len(a), np.int64)
        for step in self.steps:
            fits = np.flatnonzero(a - out - step >= 0)
            out[fits] += step * self.same(a[fits] - out[fits] - step, b[fits] - out[fits] - step, step)
        return out


def stretches(hashes: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where long runs may be, as [start, end) in order, apart from each other, one place wider than the runs.

    ``hashes`` are of words and of separators between documents, longest document first;
    ``reach[q]`` is how many places belong to documents that are long enough for period q.
    """
    at, periods = [], []
    for q in range(1, len(reach)):
        step, end = max(LEAST_WORDS, LEAST_POWER * q) - q, int(reach[q])
        found = (np.flatnonzero(hashes[step:end:step] == hashes[step - q : end - q : step]) + 1) * step
        if len(found):
            # of at least five places that agree in a row, two lie on one side of this one
            near = [(hashes[np.clip(found + d, 0, end - 1)] == hashes[np.clip(found + d - q, 0, end - 1)]) for d in (-2, -1, 1, 2)]
            found = found[(near[0] & near[1]) | (near[1] & near[2]) | (near[2] & near[3])]
            at.append(found)
            periods.append(np.full(len(found), q))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p, q = np.concatenate(at), np.concatenate(periods)
    extend = Extender(hashes)
    start, end = p - q - extend.backward(p - q, p), p + extend.forward(p - q, p)
    long = end - start >= np.maximum(LEAST_WORDS, LEAST_POWER * q)
    start, end = np.maximum(start[long] - 1, 0), np.minimum(end[long] + 1, len(hashes))
    if not len(start):
        return start, end
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    fresh = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    return start[fresh], end[np.append(fresh[1:], len(start)) - 1]


def long_runs(words: list[bytes], start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """start, length and period of the runs in [start, end) that are long enough; separators are None."""
    held: list[tuple[int, int]] = []
    size = 0
    for k, (low, high) in enumerate(zip(start.tolist(), end.tolist())):
        held.append((low, high))
        size += high - low
        if size < CLOSE_WORDS and k + 1 < len(start):
            continue
        known: dict[bytes, int] = {}
        letters, first, own = np.zeros(size + len(held), np.int64), [], 0
        for n, (a, b) in enumerate(held):
            first.append(own)
            row = []
            for x, w in enumerate(words[a:b]):
                row.append(-2 - 2 * (own + x) if w is None else 2 * known.setdefault(w, len(known)))
            letters[own : own + b - a] = row
            letters[own + b - a] = -1 - 2 * n
            own += b - a + 1
        at, length, period = runs(letters)
        long = length >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
        at, length, period = at[long], length[long], period[long]
        block = np.searchsorted(np.array(first), at, side="right") - 1
        place = at - np.array(first)[block] + np.array([a for a, _ in held])[block]
        yield from zip(place.tolist(), length.tolist(), period.tolist())
        held, size = [], 0


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its long runs as (start, length, period), in this order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    order = sorted((k for k, t in enumerate(texts) if len(t) >= LEAST_WORDS), key=lambda k: -len(texts[k]))
    if not order:
        return out
    words: list = []
    starts = []
    for k in order:
        starts.append(len(words))
        words += texts[k]
        words.append(None)
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    ends = np.array(starts[1:] + [len(words)])
    hashes[ends - 1] = mixed(np.arange(len(order)).astype(np.uint64) + np.uint64(1 << 40))
    sizes = ends - np.array(starts) - 1
    most = int(sizes[0]) // LEAST_POWER
    # documents of at least LEAST_POWER q words come first
    enough = np.searchsorted(-sizes, -LEAST_POWER * np.arange(most + 1), side="right")
    reach = np.append(0, ends)[enough]
    for place, length, period in long_runs(words, *stretches(hashes, reach)):
        nth = int(np.searchsorted(ends, place, side="right"))
        out[order[nth]].append((place - starts[nth], length, period))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that any run has after its first period."""
    if not found:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, kept.tolist()) if k]


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
FULL = ", runs array<struct<start: long, length: long, period: long>>, collapsed string"


def told(words: list[bytes], found: list[tuple[int, int, int]], full: bool) -> tuple:
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    head = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(collapsed(words, found))
    row = (len(found), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
    return (*row, [dict(zip(("start", "length", "period"), r)) for r in found], kept.decode("utf-8", "replace")) if full else row


def detected(docs: DataFrame, periodic: bool = False, full: bool = True) -> DataFrame:
    """doc_id, the number of runs, the one of the greatest power, digests and, if ``full``, the runs and the collapsed text.

    With ``periodic`` some documents are given a repetition first, by their id.
    """
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(SCHEMA + FULL * full).fields])
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    if full:
        kinds += [pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, name, texts = batch.column(0), batch.column(1), batch.column(2)
            for cut in slabs(pc.binary_length(texts).to_pylist(), SLAB):
                held = [text.split() for text in texts[cut].to_pylist()]  # bytes.split() cuts at ASCII white space alone
                if periodic:
                    held = [made_periodic(i, words) for i, words in zip(name[cut].to_pylist(), held)]
                rows = [told(words, found, full) for words, found in zip(held, runs_of_texts(held))]
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([doc[cut], *columns], names=schema.names)

    name: Column = F.col("doc_id").cast("string").alias("name")
    return docs.select("doc_id", name, text_or_empty().cast("binary").alias("text")).mapInArrow(run, schema)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(documents(spark, sf_dir), periodic=True, full=False)


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CAST(xor(list_reduce(
    list_prepend(4294967295, flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] for c in string_split(CAST(doc_id AS VARCHAR), '')])),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) AS BIGINT) AS h FROM documents
), g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS made, h // 10 % greatest(len(w), 1) AS a, h // 10 % 8 AS r FROM d
), p AS (SELECT *, 1 + (n - a) // (3 + r) AS p FROM g
), e AS (SELECT doc_id, n, made, a, p, w, unnest(range(0, n)) AS i FROM p
), x AS (SELECT doc_id, n, i, w[1 + CASE WHEN made AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM e
), m AS (SELECT u.doc_id, v.i - u.i AS q, u.i FROM x u JOIN x v ON u.doc_id = v.doc_id AND u.word = v.word AND v.i > u.i AND 4 * (v.i - u.i) <= u.n
), s AS (SELECT doc_id, q, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island, i FROM m
), l AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (SELECT doc_id, start, length, min(q) AS period FROM l GROUP BY doc_id, start, length
), top AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first(struct_pack(start := start, length := length, period := period) ORDER BY length / period DESC, start, period) AS t FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run
), kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, t.start AS start, t.length AS length, t.period AS period, 1000 * t.length // t.period AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k, '')) AS collapsed_sha256
FROM d LEFT JOIN top USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
