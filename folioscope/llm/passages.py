"""Hashes of word sequences, and anchors chosen by content.

A batch of texts is laid out as one long sequence of word hashes. Every window
of ``span`` words has an anchor: of the ``gram``-word sequences inside it, the
leftmost of those with the least hash. Equal windows have the same anchor at
the same place, and neighbouring windows mostly share one, so two texts that
share a window share an anchor while few positions are anchors.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 2**64)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    out = values ^ (values >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the batch, and where each text starts (one more than texts).

    Words are runs of anything but space and U+0009..U+000D, which is what bytes.split() cuts at.
    """
    digest = xxhash.xxh64_intdigest
    starts, out = [0], []
    for text in texts:
        out.extend([digest(w, seed) for w in text.split()])
        starts.append(len(out))
    return np.array(out, dtype=np.uint64), np.array(starts, dtype=np.int64)


def sequence_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each sequence of ``width`` words, by doubling; one for each place that has so many after it."""
    done, size, factor = None, 0, np.uint64(_MULTIPLIER)
    block, block_size, block_factor = words, 1, factor
    rest = width
    while rest:
        if rest & 1:
            if done is None:
                done, size = block, block_size
            else:
                n = max(0, len(words) - size - block_size + 1)
                done, size = done[:n] * block_factor + block[size : size + n], size + block_size
        rest >>= 1
        if rest:
            n = max(0, len(block) - block_size)
            block = block[:n] * block_factor + block[block_size : block_size + n]
            block_size *= 2
            with np.errstate(over="ignore"):
                block_factor = block_factor * block_factor
    return mixed(done)


def stretch_hashes(words: np.ndarray, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The hash of each stretch of ``width`` words from ``low``, of any widths, from sums over prefixes."""
    with np.errstate(over="ignore"):
        factors = np.full((2, len(words) + 1), 1, dtype=np.uint64)
        factors[0, 1:], factors[1, 1:] = _MULTIPLIER, _INVERSE
        ups, downs = np.cumprod(factors, axis=1, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * downs[:-1], dtype=np.uint64)])
        return mixed((sums[low + width] - sums[low]) * ups[low])


def window_anchors(grams: np.ndarray, count: int) -> np.ndarray:
    """For each run of ``count`` grams, the place of the leftmost least one."""
    at, size = np.arange(len(grams), dtype=np.int64), 1
    while size < count:
        step = min(size, count - size)
        left, right = at[: max(0, len(at) - step)], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        size += step
    return at


def in_one_text(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the first ``n`` places begin ``width`` words of a single text."""
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    return np.arange(n) + width <= ends
