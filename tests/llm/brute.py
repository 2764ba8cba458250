"""Plain versions of the numbered operators, for small fixtures."""

import hashlib
import re
from collections import Counter
from itertools import combinations
from math import log10
from zlib import crc32

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def luhn(digits):
    doubled = [int(d) * (2 if n % 2 else 1) for n, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    text = text or ""
    only = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(only(m[0])) <= 19 and luhn(only(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(only(m[0])) <= 15]
    return out


def spans_text(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def fingerprint(text):
    held = words(lower(text))
    grams = [held[k : k + 3] for k in range(len(held) - 2)] if len(held) >= 3 else [held] * bool(held)
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(ids, linked):
    """The smallest reachable id of each."""
    at = {i: i for i in ids}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a, b in combinations(sorted(ids), 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            at[y] = x
    return {i: root(i) for i in ids}


def without_repeats(docs, width=20):
    """doc_id to (n_words, n_removed, kept text); ``docs`` is [(doc_id, text)]."""
    seen, out = set(), {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        held = words(text)
        gone = set()
        for k in range(len(held) - width + 1):
            window = tuple(held[k : k + width])
            if window in seen:
                gone.update(range(k, k + width))
            seen.add(window)
        out[doc] = (len(held), len(gone), " ".join(w for k, w in enumerate(held) if k not in gone))
    return out


def repeated_places(docs, least=50):
    """doc_id to the set of word numbers that lie in a stretch of ``least`` words found at another place too."""
    met = {}
    for doc, text in docs:
        held = words(text)
        for k in range(len(held) - least + 1):
            met.setdefault(tuple(held[k : k + least]), []).append((doc, k))
    out = {doc: set() for doc, _ in docs}
    for places in met.values():
        if len(places) > 1:
            for doc, k in places:
                out[doc].update(range(k, k + least))
    return out


def unigram(docs):
    """doc_id to (held_out, n_tokens, n_known, N, base score)."""
    split = {d: crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    tokens = {d: [*words(lower(t)), "\n"] for d, t in docs}
    counts = Counter(t for d, _ in docs if not split[d] for t in tokens[d])
    n, v = sum(counts.values()), len(counts)
    return {
        d: (split[d], len(tokens[d]), sum(counts[t] > 0 for t in tokens[d]), n, sum(log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens[d]))
        for d, _ in docs
    }


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
