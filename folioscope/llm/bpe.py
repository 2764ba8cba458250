"""Byte-pair encoding as a streaming transducer with bounded lookahead, and decoding.

A merge list fixes how far to the right a text can still change a token: a
merge across a boundary can be kept from firing only by an earlier merge that
takes the symbol to its right, that one only by a still earlier one, and so on.
The ranks fall along such a chain, so the longest chain, in symbols, is a
sufficient lookahead. The transducer keeps, for each of the last few positions,
the last token of the encoding of everything up to there. It is the one token
that ends there and is compatible with the last token of what precedes it. What lies
further back than the lookahead is final and is emitted, so memory does not
grow with the text.

Words between white space do not affect each other, so a worker keeps a bounded
table of words it has transduced, and takes new ones in sorted order, each going
on from the state it shares with the one before. Long texts go through in stretches.

Decoding is a state machine over bytes: it turns ids into bytes and bytes into
text as soon as a character is whole.

Defined results: a null or empty text has no tokens; the strings of special
tokens in a text become those tokens, as the tokenizers library does; rows
that repeat are encoded alike; further columns are not looked at; ids may be of
any type; a very long text goes through in stretches; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer as Library

from .common import documents, slabs, text_or_empty

VOCABULARY = "word_bpe_49k.json"
#: Words and pre-tokens that a worker remembers, in each of two generations.
KEPT_WORDS, KEPT_PIECES = 250_000, 250_000
#: Characters of a long text that are transduced at once.
STRETCH = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
    return [out[b] for b in range(256)]


ALPHABET = byte_alphabet()
BYTE_OF = {c: b for b, c in enumerate(ALPHABET)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Merges:
    """A merge list: which tokens may stand side by side, and how far ahead one must look."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(merges)}
        self.parts = {vocab[a + b] if not suffix else vocab[a.removesuffix(suffix) + b]: (vocab[a], vocab[b]) for a, b in merges}
        self.length = {i: len(t.removesuffix(suffix)) if suffix else len(t) for t, i in vocab.items()}
        self.longest = max(self.length.values())
        #: What may stand last: tokens with the mark, by their symbols.
        self.at_end = {t.removesuffix(suffix): i for t, i in vocab.items() if t.endswith(suffix)} if suffix else vocab
        # one size alone can fit, so the order is for speed: the commonest first
        self.sizes = [3, 2, 4, 1, *range(5, self.longest + 1)]
        self._fits: dict[tuple[int, int], bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at this side (0 left, 1 right) while ``token`` was made, each with the rank of the merge that took it."""
        out, taken = [(token, float("inf"))], self.parts.get(token)
        while taken:
            out.append((taken[side], self.rank[taken]))
            taken = self.parts.get(taken[side])
        return out

    def fit(self, a: int, b: int) -> bool:
        """Whether no merge crosses the boundary when ``a`` meets ``b``.

        A merge of two edge tokens crosses it if it comes before the left one is
        taken, and not after the right one is: of equal merges the leftmost goes first.
        """
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) > 200_000:
                self._fits.clear()
            rank = self.rank
            right = self.edge(b, 0)
            known = not any(
                (r := rank.get((x, y))) is not None and r < by_x and r <= by_y for x, by_x in self.edge(a, 1) for y, by_y in right
            )
            self._fits[a, b] = known
        return known

    @property
    @lru_cache(maxsize=1)  # noqa: B019  one merge list a process
    def lookahead(self) -> int:
        """Symbols to the right of a boundary that can still change it, at most."""
        ranks: dict[int, list[int]] = {}
        reach: dict[int, list[int]] = {}  # the longest chain from merges that take this token on the left, up to each of ranks
        most = 0
        for (a, b), r in self.rank.items():
            chain = 0
            for token, by in self.edge(b, 1):
                held = ranks.get(token)
                if held:
                    low, high = 0, len(held)
                    limit = min(by, r)
                    while low < high:
                        middle = (low + high) // 2
                        low, high = (middle + 1, high) if held[middle] < limit else (low, middle)
                    if low:
                        chain = max(chain, reach[token][low - 1])
            total = self.length[b] + chain
            most = max(most, total)
            ranks.setdefault(a, []).append(r)
            best = reach.setdefault(a, [])
            best.append(max(total, best[-1] if best else 0))
        return most + self.longest

    def stream(self, symbols: str) -> Iterator[int]:
        """Tokens of one pre-token, emitted once stable. ``symbols`` are of the byte alphabet."""
        vocab, fit, length = self.vocab, self.fit, self.length
        end, longest = len(symbols), self.longest
        hold = self.lookahead + longest
        last: list[int] = [-1]  # of the prefix that ends at base + k
        base = done = 0
        for i in range(1, end + 1):
            tail = self.suffix if i == end else ""
            for size in self.sizes:
                start = i - size
                if start < base:
                    continue
                token = vocab.get(symbols[start:i] + tail)
                if token is not None:
                    before = last[start - base]
                    if (before < 0 and start == 0) or (before >= 0 and fit(before, token)):
                        last.append(token)
                        break
            else:
                raise ValueError("the vocabulary lacks a symbol")
            if i == end or i - base >= 2 * hold:
                limit = end if i == end else i - hold
                path, at = [], i
                while at > done:
                    token = last[at - base]
                    if at <= limit:
                        path.append(token)
                    at -= length[token]
                stable = done + sum(length[t] for t in path)
                yield from reversed(path)
                done = stable
                cut = max(base, min(done, i - longest))
                last, base = last[cut - base :], cut

    def transduced(self, pieces: list[str]) -> Iterator[bytes]:
        """The tokens of each of ``pieces`` (sorted, of the byte alphabet) as little-endian 32-bit numbers.

        What the transducer holds after a prefix depends on the prefix alone, so
        a piece goes on from where it parts with the one before. Pieces within the
        lookahead are emitted at their end; longer ones are streamed.
        """
        vocab, at_end, fits, fit, length, sizes = self.vocab, self.at_end, self._fits, self.fit, self.length, self.sizes
        most = self.lookahead + self.longest
        before, last = "", [-1]
        for symbols in pieces:
            end = len(symbols)
            if end > most:
                yield array("I", self.stream(symbols)).tobytes()
                continue
            shared, limit = 0, min(len(before), end, len(last)) - 1
            while shared < limit and before[shared] == symbols[shared]:
                shared += 1
            before = symbols
            del last[shared + 1 :]
            for i in range(shared + 1, end + 1):
                known = at_end if i == end else vocab
                for size in sizes:
                    start = i - size
                    if start < 0:
                        continue
                    token = known.get(symbols[start:i])
                    if token is not None:
                        held = last[start]
                        if start == 0:
                            break
                        if held >= 0:
                            fitting = fits.get((held, token))
                            if fit(held, token) if fitting is None else fitting:
                                break
                else:
                    raise ValueError("the vocabulary lacks a symbol")
                last.append(token)
            path, at = [], end
            while at > 0:
                token = last[at]
                path.append(token)
                at -= length[token]
            path.reverse()
            del last[end:]  # with the end-of-word mark, so no prefix of another piece
            yield array("I", path).tobytes()


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")
        self.surface = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.surface |= {i: t for t, i in self.special.items()}
        self.bytes_of = [self.surface.get(i, "").encode("utf-8") for i in range(max(self.surface) + 1)]
        self.table = pa.array(self.bytes_of, pa.binary())
        steps = held["pre_tokenizer"]["pretokenizers"]
        self.piece = regex.compile(steps[0]["pattern"]["Regex"])
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.separator = re.compile("[\x1c-\x1f]")
        self.blank = regex.compile(r"\p{White_Space}+")
        #: What code points normalise to and are cut into is for the library to say: its tables are of another Unicode version than Python's.
        library = Library.from_file(path)
        self.normalised, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def symbols(self, piece: str) -> str:
        return piece if piece.isascii() and piece.isprintable() else "".join(map(ALPHABET.__getitem__, piece.encode()))

    def word_pieces(self, word: str) -> list[str]:
        """Pre-tokens of text without white space and special tokens, of the byte alphabet."""
        if word.isascii():
            return list(map(self.symbols, self.piece.findall(word.lower())))
        return [piece for piece, _ in self.cut(self.normalised(word))]

    def parts(self, word: str) -> list[str | int]:
        """A word between white space as pre-tokens and ids of special tokens."""
        if "<|" not in word:
            return self.word_pieces(word)
        out: list[str | int] = []
        for part in self.split_special.split(word):
            if part in self.special:
                out.append(self.special[part])
            else:
                out.extend(self.word_pieces(part))
        return out

    def learn(self, words: set[str]) -> None:
        """Transduce what is not remembered; afterwards ``self.words`` has the ids of all of ``words``.

        What is asked for again outlives what is not: a full table becomes the older one.
        """
        if len(self.words) > KEPT_WORDS or len(self.pieces) > KEPT_PIECES:
            self.older, self.words, self.pieces = (self.words, self.pieces), {}, {}
        known, (old_words, old_pieces) = self.words, self.older
        wanted = words - known.keys()
        again = wanted & old_words.keys()
        for word in again:
            known[word] = old_words[word]
        cut = {word: self.parts(word) for word in wanted - again}
        asked = {p for parts in cut.values() for p in parts if type(p) is str} - self.pieces.keys()
        for piece in asked & old_pieces.keys():
            self.pieces[piece] = old_pieces[piece]
        fresh = sorted(asked - old_pieces.keys())
        for piece, ids in zip(fresh, self.merges.transduced(fresh)):
            self.pieces[piece] = ids
        pieces = self.pieces
        for word, parts in cut.items():
            known[word] = b"".join([pieces[p] if type(p) is str else p.to_bytes(4, "little") for p in parts])

    def split(self, text: str) -> list[str]:
        odd = self.separator.search(text)  # str.split() takes these for white space; the vocabulary does not
        return list(filter(None, self.blank.split(text))) if odd else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit numbers. Words do not affect each other, so each is transduced once."""
        held = [self.split(text) for text in texts]
        self.learn(set().union(*held))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in held]

    def ids(self, text: str) -> list[int]:
        return memoryview(self.encode([text])[0]).cast("I").tolist()

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


class Decoder:
    """Ids to text, incrementally: a state machine that turns ids into bytes and bytes into text.

    The state is the bytes of a character not yet whole, and whether a token
    came before. The end-of-word mark ends a word with a space; with
    ``surface``, tokens are written as the vocabulary has them, one space
    between, as the tokenizers library does for a file that names no decoder.
    """

    def __init__(self, tokenizer: Tokenizer, surface: bool = False):
        self.tokenizer, self.surface, self.first = tokenizer, surface, True
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.surface:
            held = b" ".join(map(self.tokenizer.bytes_of.__getitem__, ids))
            return self.step(held, bool(len(held)))
        tokens = map(self.tokenizer.surface.__getitem__, ids)
        out = []
        suffix = self.tokenizer.merges.suffix
        for token in tokens:
            if token in self.tokenizer.special:
                out.append(self.state.decode(b"", True) + token)
                self.state.reset()
            else:
                ends = bool(suffix) and token.endswith(suffix)
                raw = bytes(map(BYTE_OF.__getitem__, token.removesuffix(suffix) if ends else token))
                out.append(self.state.decode(raw) + " " * ends)
        return "".join(out)

    def step(self, held: bytes, any_token: bool) -> str:
        """The text of the bytes of the next tokens, joined by spaces."""
        lead = b"" if self.first or not any_token else b" "
        self.first = self.first and not any_token
        return self.state.decode(lead + held)

    def finish(self) -> str:
        return self.state.decode(b"", True)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One a worker process: the tables stay between tasks."""
    return Tokenizer(path)


def joined_bytes(tok: Tokenizer, raws: list[bytes]) -> list[bytes]:
    """For each row of ids, the bytes of its tokens with spaces between: looked up and joined for all rows at once."""
    counts = np.array([len(r) // 4 for r in raws], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    tokens = tok.table.take(pa.array(np.frombuffer(b"".join(raws), dtype="<u4")))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens), b" ").to_pylist()


class Digests:
    """Of one text, fed stretch by stretch: its ids and what they decode to."""

    def __init__(self, tok: Tokenizer):
        self.decoder, self.n = Decoder(tok, surface=True), 0
        self.of_ids, self.of_text = hashlib.sha256(), hashlib.sha256()

    def feed(self, raw: bytes, shown: bytes) -> None:
        self.n += len(raw) // 4
        self.of_ids.update(raw)
        self.of_text.update(self.decoder.step(shown, bool(raw)).encode("utf-8"))

    def done(self) -> tuple[int, str, str]:
        self.of_text.update(self.decoder.finish().encode("utf-8"))
        return self.n, self.of_ids.hexdigest(), self.of_text.hexdigest()


def encoded_rows(tok: Tokenizer, texts: list[str]) -> Iterator[tuple[list[bytes], tuple[int, str, str]]]:
    """For each text the ids of its stretches, and count and digests. Long texts take turns of a stretch."""
    short = [k for k, text in enumerate(texts) if len(text) <= 2 * STRETCH]
    raws = tok.encode([texts[k] for k in short])
    ready = dict(zip(short, zip(raws, joined_bytes(tok, raws))))
    for k, text in enumerate(texts):
        digests, kept = Digests(tok), []
        if k in ready:
            raw, shown = ready.pop(k)
            digests.feed(raw, shown)
            kept.append(raw)
        else:
            for stretch in tok.stretches(text):
                held = tok.encode([stretch])
                digests.feed(held[0], joined_bytes(tok, held)[0])
                kept += held
        yield kept, digests.done()


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, the ids of every row."""
    path = path or default_path()
    fields = [docs.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            doc, texts = batch.column(0), batch.column(1)
            for cut in slabs(pc.binary_length(texts).to_pylist(), 4 << 20):
                rows = [(b"".join(raw) if with_ids else b"", told) for raw, told in encoded_rows(tok, texts[cut].to_pylist())]
                counts, ids_sha, text_sha = zip(*(told for _, told in rows))
                columns = [doc[cut], pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw for raw, _ in rows), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, T.StructType(fields))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir), with_ids=False)
