"""The Merkle manifest, packing and runs against plain versions, with odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from llm import brute

from folioscope.llm import bpe, merkle, packing, periodic, tandem

CLASHING = ["sk", "hash", "pos", "n", "row", "run", "kids", "held", "task", "at", "size", "nth", "name", "root", "told"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    """A source of several levels, one of a single row, one of 17, null ones; repeated rows, odd texts."""
    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice(["Kite", "ash", "é", "Wind", "x9"]) + str(rng.randrange(30)) for _ in range(n))
    out = [(k, text(rng.randrange(60)), "en", "hot", k % 7) for k in range(300)]
    out += [(1000 + k, text(20), None, "b", None) for k in range(17)] + [(2000, text(3), "de", "a", 5)]
    out += [(3000 + k, text(9), "de", None, 5) for k in range(3)]
    out += [(5, "again ABC", "en", "hot", 1)] * 20 + [(None, "No Id", "en", "hot", 1), (4000, None, None, "hot", None), (4001, "", None, "é", 0)]
    out += [(5003, " ".join(["W0", "W1", "W2"] * 3000), "en", "b", 1), (5002, text(30_000), "en", "b", 1)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    names = ", ".join(f"`{c}` int" for c in CLASHING)
    made = [(*r, *range(len(CLASHING))) for r in rows]
    return spark.createDataFrame(made, f"doc_id long, text string, lang string, source string, n_chars long, {names}").repartition(5)


def leaf(doc, text, lang, source, n):
    parts = [None if v is None else str(v) for v in (doc, source, lang, n, text)]
    return sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def climbed(hashes):
    """The top of a list of hashes, and for each the siblings around it, level by level."""
    paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        cut = [level[k : k + 16] for k in range(0, len(level), 16)]
        for path, p in zip(paths, at):
            run, place = cut[p // 16], p % 16
            path.append(("".join(run[:place]), "".join(run[place + 1 :])))
        at = [p // 16 for p in at]
        level = [sha("".join(run)) for run in cut]
    return (level[0] if level else None), paths


def plain_manifest(rows):
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        by[source].append(((doc is not None, doc or 0), leaf(doc, text, lang, source, n), doc, text, lang, n))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climbed([r[1] for r in sorted(by[s], key=lambda r: r[:2])]) for s in order}
    root, over = climbed([tops[s][0] for s in order])
    out = []
    for s, upper in zip(order, over):
        for (_, own, doc, text, lang, n), path in zip(sorted(by[s], key=lambda r: r[:2]), tops[s][1]):
            path = path + upper
            changed = doc is not None and crc32(str(doc).encode()) % 5 == 0
            now = leaf(doc, brute.lower(text) if text is not None else None, lang, s, n) if changed else own
            for before, after in path:
                now = sha(before + now + after)
            out.append((doc, own, tops[s][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return out


def test_manifest_equals_a_plain_tree(table, rows):
    got = merkle.verified(table)
    want = plain_manifest(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert 0 < sum(w[-1] for w in want) < len(want)


def test_manifest_of_text_ids_few_rows_and_none(spark):
    of = "doc_id string, text string, lang string, source string, n_chars long"
    one = [("d1", "A", None, "s", 1)]
    for held in (one, one + [("d0", "B", None, None, None)], [(f"d{k:03d}", "T", "en", f"s{k}", k) for k in range(40)]):
        def told(out):
            return sorted((r[0], r[1], r[3], r[4]) for r in out)

        assert told(map(tuple, merkle.verified(spark.createDataFrame(held, of)).collect())) == told((d, *r) for d, *r in plain_text_ids(held))
    assert merkle.verified(spark.createDataFrame([], of)).count() == 0
    assert merkle.manifest(merkle.tampered(spark.createDataFrame([], of))).root() is None


def plain_text_ids(rows):
    by = defaultdict(list)
    for doc, text, lang, source, n in rows:
        by[source].append((doc, leaf(doc, text, lang, source, n)))
    order = sorted(by, key=lambda s: (s is not None, s or ""))
    tops = {s: climbed([h for _, h in sorted(by[s])]) for s in order}
    root, over = climbed([tops[s][0] for s in order])
    for s, upper in zip(order, over):
        for (doc, own), path in zip(sorted(by[s]), tops[s][1]):
            yield doc, own, tops[s][0], root, sha("".join(a + b for a, b in path + upper))


def test_manifest_is_kept_where_asked_and_told_from_a_change(spark, table, tmp_path):
    made = merkle.manifest(merkle.tampered(table), f"file://{tmp_path}/held")
    again = merkle.manifest(merkle.tampered(table.repartition(3)))
    assert made.root() == again.root() and len(made.by_source.levels) == 3
    assert spark.read.parquet(f"file://{tmp_path}/held/sources/level-0").count() == made.by_source.levels[0].count()
    other = table.replace(1, 2, ["n_chars"])
    assert merkle.manifest(merkle.tampered(other)).root() != made.root()


def test_packing_covers_every_id_once_without_padding(table, rows):
    tok = bpe.tokenizer(bpe.default_path())
    found = packing.packed(table, step_tokens=1 << 14).collect()
    want = Counter((r[0], tuple([*tok.ids(r[1] or ""), 2])) for r in rows)
    by_doc, windows = defaultdict(list), defaultdict(list)
    for r in found:
        assert crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_doc[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    assert sum(r.length for r in found) == sum(len(ids) * n for (_, ids), n in want.items())
    for (doc, ids), n in want.items():
        places = Counter()
        for r in by_doc[doc]:
            if r.doc_tokens == len(ids) and tuple(r.ids) == ids[r.start : r.start + r.length]:
                places.update(range(r.start, r.start + r.length))
        assert sorted(places) == list(range(len(ids))) and (min(places.values()) >= n)
    assert sorted(windows) == list(range(len(windows)))
    steps, sizes = Counter(), Counter()
    for held in windows.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == held[0].size <= 4096 and at & (at - 1) == 0
        steps[held[0].step_group] += at
        sizes[at] += 1
    assert {256, 4096} <= set(sizes) and all(n <= 5 for size, n in sizes.items() if size < 256)  # one of each smaller power a task
    assert sorted(steps) == list(range(len(steps))) and max(steps.values()) - min(steps.values()) <= 4096


def test_packing_at_random():
    rng = random.Random(3)
    for _ in range(200):
        pool, given, got = packing.Pool((4, 8, 16)), 0, []
        for k in range(rng.randrange(40)):
            n = rng.randrange(1, 17)
            pool.add(packing.Piece((k, n), 0, bytes(4 * n)))
            given += n
            if rng.random() < 0.3:
                got += pool.windows()
                assert pool.held < 16
        got += pool.windows(last=True)
        sizes = [sum(p.length for p in w) for w in got]
        assert sum(sizes) == given and not pool.held and all(s & (s - 1) == 0 for s in sizes)
        spans = Counter((p.doc[0], i) for w in got for p in w for i in range(p.start, p.start + p.length))
        assert len(spans) == given


def test_packing_takes_any_id_and_streams_long_texts(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    tok = packing.Encoder(bpe.default_path())
    text = " ".join(f"w{k}" for k in range(400))
    texts = pa.array([text, "ab", text])
    held = [b"".join(s) for s in packing.id_stretches(tok, texts)]
    assert held == tok.encode(texts)
    full, rest, n = packing.whole_windows([held[0]], 2, 64)
    assert n == len(held[0]) // 4 + 1 and b"".join(ids for _, ids, _ in full) + rest == held[0] + (2).to_bytes(4, "little")
    df = spark.createDataFrame([("x", None), ("y", "a b"), (None, "c")], "doc_id string, text string")
    assert {(r.doc_id or "", r.doc_tokens) for r in packing.packed(df).collect()} == {("", 2), ("x", 1), ("y", 3)}
    assert packing.packed(df.limit(0)).count() == 0


def test_packing_encodes_as_the_library_does(smoke_dir):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    library, tok = Tokenizer.from_file(bpe.default_path()), packing.Encoder(bpe.default_path())
    library.no_padding()
    library.no_truncation()
    rng = random.Random(6)
    texts = [t or "" for t in pq.read_table(f"{smoke_dir}/documents.parquet", columns=["text"])["text"].to_pylist()]
    texts += ["a<|endoftext|>b <x <|", "İstanbul ΣΑΣ ﬁ", "\x1c\x1d x", "don't I'LL 3.14", "a" * 300, " \u3000x", "", "  \t", "a\0b \0 c", "\u00a0x\u2003y"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3400), 32, 0x301, 0x1AC6])) for _ in range(8)) for _ in range(4000)]
    for low in range(0, len(texts), 500):
        for text, ids in zip(texts[low : low + 500], tok.encode(pa.array(texts[low : low + 500]))):
            assert memoryview(ids).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def plain_runs(words, least=4):
    out = {}
    for q in range(1, len(words) // 2 + 1):
        same = [a == b for a, b in zip(words, words[q:])] + [False]
        i = 0
        for j, s in enumerate(same):
            if not s:
                if j - i >= max(1, (least - 1) * q) and j - i + q >= (6 if least == 4 else 0):
                    out.setdefault((i, j - i + q), q)
                i = j + 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def periodic_text(rng, n):
    letters, out = rng.choice([1, 2, 3, 5, 30]), []
    while len(out) < n:
        root = [rng.randrange(letters) for _ in range(rng.randrange(1, 9))]
        out += root * rng.randrange(1, 8) + root[: rng.randrange(len(root) + 1)]
        if rng.random() < 0.5:
            out.append(rng.randrange(letters + 1))
    return out


def test_tandem_finds_all_runs():
    rng = random.Random(8)
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 150:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cases = [periodic_text(rng, rng.randrange(60)) for _ in range(400)] + [list(map(ord, fibonacci[-1][k:])) for k in range(5)]
    cases += [[rng.randrange(2) for _ in range(rng.randrange(50))] for _ in range(400)]
    for case in cases:
        got = sorted(zip(*(c.tolist() for c in tandem.runs(np.array(case, np.int64)))), key=lambda r: (r[0], r[2]))
        assert got == plain_runs(case, 2), case


def test_long_runs_of_many_texts_at_once():
    rng = random.Random(9)
    for _ in range(60):
        texts = [[b"w%d" % v for v in periodic_text(rng, rng.randrange(120))] for _ in range(rng.randrange(1, 8))]
        assert periodic.runs_of_texts(texts) == [plain_runs(t) for t in texts]


def test_runs_of_documents(table, rows):
    made = {}
    for doc, text, *_ in rows:
        words = [w.encode() for w in brute.words(text)]
        h, n = crc32(str(doc).encode()), len(words)
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        made[doc, text] = words
    got = Counter(tuple(r) for r in periodic.detected(table, periodic=True, full=False).collect())
    want = Counter()
    for doc, text, *_ in rows:
        words = made[doc, text]
        found = plain_runs(words) if len(words) < 10_000 else [(0, 9000, 3)] if doc == 5003 else []
        top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        listed = sha("".join("%d,%d,%d\n" % r for r in found))
        want[(doc, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, listed, hashlib.sha256(kept).hexdigest())] += 1
    assert crc32(b"5003") % 10 and crc32(b"5002") % 10
    assert got == want


def test_runs_with_their_texts(spark):
    df = spark.createDataFrame([("a", "x " + "b c " * 5 + "d"), ("b", None), ("c", "q q q\x0bq\n q q  q q")], "doc_id string, text string")
    got = {r.doc_id: r for r in periodic.detected(df).collect()}
    assert [tuple(r) for r in got["a"].runs] == [(1, 10, 2)] and got["a"].collapsed == "x b c d"
    assert (got["b"].n_runs, got["b"].start, got["b"].runs_sha256, got["b"].collapsed) == (0, None, sha(""), "")
    assert [tuple(r) for r in got["c"].runs] == [(1, 6, 1)] and got["c"].collapsed == "q q q"
    assert periodic.detected(df.limit(0)).count() == 0
