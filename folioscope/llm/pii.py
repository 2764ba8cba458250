"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds to them.

The network is trained in numpy from labelled spans: those of the patterns in a
sample of ``SAMPLE_DOCS`` documents (a documented bound) and invented ones in forms that
the patterns miss, set into the sampled prose. Every whole text is cut into
overlapping windows; a window is decoded by Viterbi, each character takes its
tag from the window in which it lies furthest from an edge, and runs of a tag
are spans of the document. A span of the network stays if it passes its kind's
plain check and touches no pattern span.

Defined results: a null or empty text has no spans; rows that repeat get the
same spans; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, first_by_hash, slabs, text_or_empty
from .lstm_crf import BiLstmCrf

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is taken whole, so that a long one is read once.
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

SAMPLE_DOCS, UPDATES = 600, 450
#: Stretches of a sampled document that come to the driver, at most this many around digits and half as many from anywhere, and their characters to each side.
WINDOWS, REACH = 12, 200
#: What written-out data look like.
UNSURE = re.compile(r"[\[(](?:at|dot|\.)[\])]", re.IGNORECASE)
STEPS, EDGE = 256, 16
CORE = STEPS - 2 * EDGE
#: Windows decoded at once, and the code of a place outside the text.
ROWS, OUTSIDE, OTHER = 2048, 129, 128

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        value = int(d) * (1 + n % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        host = HOST.match(text, at + 1) if left < at else None
        if host:
            done = host.end()
            yield 0, left, done
        at = text.find("@", max(done, at + 1))


def is_address(text: str) -> bool:
    return all(len(p) < 4 or not p[:-3].strip("0") for p in text.split(".")) and all(int(p[-3:]) <= 255 for p in text.split("."))


def is_card(text: str) -> bool:
    digits = NOT_DIGIT.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGIT.sub("", text)) <= 15


def pattern_spans(text: str) -> list[Span]:
    """By kind, then start."""
    out = list(_emails(text))
    out += [(1, *m.span()) for m in ADDRESS.finditer(text) if is_address(m.group())]
    out += [(2, *m.span()) for m in NUMBER.finditer(text) if is_card(m.group())]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if is_phone(m.group())]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


# --- training -------------------------------------------------------------


def invented(rng: random.Random) -> tuple[int, str]:
    """A labelled example: kind (or -1 for what is no personal data) and its text."""

    def word(low: int = 3, high: int = 9) -> str:
        return "".join(rng.choice("abcdefghiklmnoprstuvwz") for _ in range(rng.randint(low, high)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    kind = rng.choice((0, 0, 1, 2, 3, -1))
    if kind == 0:
        user, host, top = word() + rng.choice(["", ".", "_"]) + rng.choice([word(), digits(2)]), word(), rng.choice(["com", "org", "net", "example.com"])
        # written-out forms are what the network is for: the patterns have the plain one
        written = [f"{user} [at] {host} [dot] {top}", f"{user} (at) {host} (dot) {top}"]
        return 0, rng.choice([f"{user}@{host}.{top}", *written, *written, f"{user} (at) {host} (dot) {top}"])
    if kind == 1:
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return 1, rng.choice([".".join(parts), ".".join(parts), "[.]".join(parts), "(.)".join(parts)])
    if kind == 2:
        number = digits(15)
        number = next(number + c for c in "0123456789" if luhn(number + c))
        groups = [number[k : k + 4] for k in range(0, 16, 4)]
        return 2, rng.choice([number, " ".join(groups), "-".join(groups), ".".join(groups), "/".join(groups)])
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return 3, rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"00{rng.randint(1, 99)} {a} {b} {c}"])
    return -1, rng.choice([digits(rng.randint(1, 8)), f"20{digits(2)}-0{rng.randint(1, 9)}-{digits(2)}", f"{digits(1)}.{digits(1)}.", f"password={rng.getrandbits(70):x}", f"token = \"{rng.getrandbits(160):x}\"", f"AKIA{word(12, 16).upper()}", f"@{word()}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}"])


def coded(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), OTHER).astype(np.uint8)


def drawer(texts: list[str], rows: int = 64, steps: int = 96):
    """Batches of windows: the patterns' spans where they lie, invented ones set into prose, and prose alone.

    Texts that may hold written-out data, which no pattern labels, are left out: they would teach the opposite.
    """
    texts = [t for t in texts if not UNSURE.search(t)]
    real = [(t, pattern_spans(t)) for t in texts]
    spotted = [(t, s, spans) for t, spans in real for s in spans]
    prose = [t for t in texts if t] or [" "]

    def window(rng: random.Random) -> tuple[str, list[Span]]:
        dice = rng.random()
        if dice < 0.3 and spotted:
            text, (_, a, b), spans = rng.choice(spotted)
            start = max(0, a - rng.randrange(steps // 2))
            return text[start : start + steps], [(k, max(0, x - start), min(steps, y - start)) for k, x, y in spans if x < start + steps and y > start]
        text = rng.choice(prose)
        start = rng.randrange(max(1, len(text) - steps))
        text = text[start : start + steps]
        if dice < 0.85:
            kind, made = invented(rng)
            at = rng.choice([m.end() for m in re.finditer(r"\s", text)] or [0])
            tail = rng.choice([" ", " ", ". ", ", ", "\n"])
            text = (text[:at] + made + tail + text[at:])[:steps]
            return text, [(kind, at, min(steps, at + len(made)))] if kind >= 0 and at < steps else []
        return text, pattern_spans(text)

    def draw(k: int) -> tuple[np.ndarray, np.ndarray]:
        rng = random.Random(k)
        codes, gold = np.full((steps, rows), OUTSIDE, np.uint8), np.zeros((steps, rows), np.int64)
        for row in range(rows):
            text, spans = window(rng)
            held = coded(text)
            codes[: len(held), row] = held
            for kind, a, b in spans:
                gold[a:b, row] = kind + 1
        return codes, gold

    return draw


def sample_windows() -> Column:
    """At most ``WINDOWS`` stretches of a text around digits and @, and some from anywhere, so a sampled document is a few kilobytes however long it is."""
    text = F.col("text")
    busy = F.slice(F.regexp_extract_all("text", F.lit(rf"(?s).{{0,{REACH}}}[0-9@].{{0,{REACH}}}"), F.lit(0)), 1, WINDOWS)
    room = F.greatest(F.length(text) - 2 * REACH, F.lit(1))
    free = F.transform(F.sequence(F.lit(0), F.lit(WINDOWS // 2 - 1)), lambda k: F.substring(text, F.pmod(F.xxhash64("doc_id", k), room).cast("int") + 1, F.lit(2 * REACH)))
    return F.concat(busy, free)


def trained(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, updates: int = UPDATES) -> BiLstmCrf:
    """Half of the sample has digits or an @, where there are such documents."""
    held = docs.select("doc_id", text_or_empty().alias("text"))
    is_busy = F.col("text").rlike("[0-9@]")
    n = held.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_busy).alias("busy")).first()
    busy = first_by_hash(held.where(is_busy), sample_docs // 2, n["busy"], sample_windows())
    any_docs = first_by_hash(held, sample_docs // 2, n["all"], sample_windows())
    texts = sorted(w for windows in busy + any_docs for w in windows)
    model = BiLstmCrf(OUTSIDE + 1, len(KINDS) + 1)
    model.train(drawer(texts), updates)
    return model


# --- decoding -------------------------------------------------------------


def tag_runs(model: BiLstmCrf, texts: list[np.ndarray]) -> list[list[Span]]:
    """Runs of a tag in each of the coded texts."""
    out: list[list[Span]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    if not lengths.sum():
        return out
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate(texts)
    cores = -(-lengths // CORE)
    owner = np.repeat(np.arange(len(texts)), cores)
    core = (np.arange(len(owner)) - np.repeat(np.cumsum(cores) - cores, cores)) * CORE
    tags: dict[int, np.ndarray] = {}
    steps = np.arange(STEPS)[:, None]
    for k in range(0, len(owner), ROWS):
        own, begin = owner[k : k + ROWS], core[k : k + ROWS] - EDGE
        # short texts need fewer steps
        span = int(min(STEPS, (lengths[own] - begin).max() + 1))
        place = begin[None, :] + steps[:span]
        inside = (place >= 0) & (place < lengths[own][None, :])
        codes = np.where(inside, flat[np.clip(place + offsets[own][None, :], 0, len(flat) - 1)], OUTSIDE)
        emit = model.emissions(codes)
        rows = np.nonzero(model.may_hold(emit))[0]
        if not len(rows):
            continue
        paths = model.decode(np.ascontiguousarray(emit[:, :, rows]))
        for row, path in zip(rows, paths.T):
            low, n = int(begin[row]), int(own[row])
            middle = path[EDGE : EDGE + CORE]
            middle = middle[: max(0, int(lengths[n]) - low - EDGE)]
            if middle.any():
                tags.setdefault(n, np.zeros(int(lengths[n]), np.int8))[low + EDGE : low + EDGE + len(middle)] = middle
    for n, held in tags.items():
        cuts = np.nonzero(np.diff(held, prepend=0, append=0))[0]
        for a, b in zip(cuts, cuts[1:]):
            if held[a]:
                out[n].append((int(held[a]) - 1, int(a), int(b)))
    return out


def plausible(kind: int, text: str) -> bool:
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|\[at\]|\(at\)) ?[\w-]+( ?(\.|\[dot\]|\(dot\)) ?[\w-]+)+", text))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}((\.|\[\.\]|\(\.\))[0-9]{1,3}){3}", text)) and all(int(x) <= 255 for x in re.findall("[0-9]+", text))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", text)) and is_card(text)
    return bool(re.fullmatch(r"(\+|00|\()[0-9 ().-]+[0-9]", text)) and is_phone(text)


def trimmed(span: Span, text: str) -> Span:
    kind, a, b = span
    while a < b and text[a] in " .,;:\n\t":
        a += 1
    while a < b and text[b - 1] in " .,;:\n\t":
        b -= 1
    return kind, a, b


def all_spans(model: BiLstmCrf, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text: the patterns' spans, and those with the network's added."""
    codes = [coded(t) for t in texts]
    found = tag_runs(model, codes)
    out = []
    for text, code, runs in zip(texts, codes, found):
        marked = (code == 64) | ((code >= 48) & (code <= 57))  # an @ or a digit: no pattern does without
        base = pattern_spans(text) if marked.any() else []
        more = [s for s in (trimmed(r, text) for r in runs) if s[1] < s[2] and plausible(s[0], text[s[1] : s[2]])]
        more = [s for s in more if not text[s[1] - 1 : s[1]].isalnum() and not text[s[2] : s[2] + 1].isalnum()]
        more = [s for s in more if not any(s[1] < b and a < s[2] for _, a, b in base)]
        out.append((base, sorted(base + more)))
    return out


def detected(docs: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """doc_id, counts by kind, digest of the patterns' spans, all spans and how many the network added."""
    model = model or trained(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    fields = [docs.schema["doc_id"], *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS)]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            # large slabs: the network is quicker the more windows it sees at once
            for cut in slabs(pc.binary_length(texts).to_pylist(), 8 << 20):
                found = all_spans(held.value, texts[cut].to_pylist())
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
                shas = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
                spans = [joined(both) for _, both in found]
                added = [len(both) - len(base) for base, both in found]
                yield pa.RecordBatch.from_arrays(
                    [ids[cut], *counts, pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())],
                    names=[f.name for f in fields],
                )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, T.StructType(fields))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(documents(spark, sf_dir))
