"""What the scoring operator does in fewer steps gives the results of the plain way."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from folioscope.llm import lm_scoring
from folioscope.llm.gru import Gru


def network(words: int = 40, classes: int = 24, size: int = 16) -> Gru:
    bounds = np.linspace(0, words, classes + 1).astype(np.int64)
    return Gru.fresh(bounds, classes, np.zeros(2 * classes), np.zeros(words), size, seed=5)


def peak_mb(work) -> float:
    tracemalloc.start()
    work()
    out = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out


def test_scores_are_made_in_stretches():
    """Of 131,072 places and 48 classes all scores at once would be 25 MB, several times over."""
    gru, n = network(), 1 << 17
    rng = np.random.default_rng(1)
    states = np.tanh(rng.standard_normal((16, n))).astype(np.float32)
    classes = rng.integers(24, 48, n)
    words = np.full(n, -1)
    assert peak_mb(lambda: gru.log_probs(states, classes, words)) < 40
    assert peak_mb(lambda: gru.loss_back(states, classes, words)) < 50


def test_tokens_are_those_of_bytes():
    rng = random.Random(3)
    shown = b" \t\n\x0b\x0c\r\x1c\x1f\xa0\x00aAbZ\xc3\xa9"
    texts = [bytes(rng.choice(shown) for _ in range(rng.randrange(12))) for _ in range(2000)]
    for held in (pa.array(texts, pa.binary()), pa.array([b"left out", *texts], pa.binary())[1:], pa.chunked_array([pa.array(texts[:7], pa.binary()), pa.array(texts[7:], pa.binary())]), pa.array([b"", b" "], pa.binary())):
        tokens, numbers, starts = lm_scoring.numbers_of(held)
        told = tokens.to_pylist()
        assert len(set(told)) == len(told) and np.bincount(numbers, minlength=len(told)).min() > 0
        for text, a, b in zip(held.to_pylist(), starts[:-1], starts[1:], strict=True):
            assert [told[k] for k in numbers[a:b]] == [*text.lower().split(), b"\n"]


def test_tokens_are_no_objects():
    """A million words held one by one would be over 40 MB of objects."""
    held = pa.array([b" ".join(b"w%d" % (k % 50_000) for k in range(1_000_000))], pa.binary())
    assert peak_mb(lambda: lm_scoring.numbers_of(held)) < 40


def test_texts_score_alike_in_any_company():
    """Texts read one after the other in a row score as each does alone, whatever their lengths; no text gets an empty row."""
    gru, rng = network(), np.random.default_rng(2)
    gru.class_bias[:] = rng.standard_normal(48)
    gru.to_class *= 30  # scores that need a shift
    texts = []
    for length in [700, 1, 2, 33, 32, 64, *rng.integers(1, 90, 60)]:
        words = rng.integers(-20, 40, length)
        classes = np.where(words >= 0, np.searchsorted(gru.bounds, words, side="right") - 1, rng.integers(24, 48, length))
        words = np.maximum(words, -1)
        shown = np.where(words >= 0, words, 40 + classes - 24)
        texts.append((np.concatenate([[64], shown[:-1]]), classes, words))
    alone = np.array([gru.score([text])[0] for text in texts])
    for rows in (1, 3, 512):
        assert np.allclose(gru.score(texts, rows=rows), alone, rtol=1e-5)
    assert np.isfinite(alone).all() and np.allclose(gru.score(texts[::-1])[::-1], alone, rtol=1e-5)
