"""A gated recurrent language model in numpy: class-factored output, truncated backpropagation through time.

Words are split into head words, each in a class with its own softmax given the
state, and tail classes, whose words share a fixed distribution given by
counts. The probability of a word is that of its class given the state times
that of the word in its class.

Methods take and give states as (units, places). In memory a place's units lie
together, gates lie one after the other, and scores are made for ``STRETCH``
places at a time, so that what a step works on stays in a core's cache.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np

F32 = np.float32
#: Places whose scores are made at once.
STRETCH = 4096
WEIGHTS = ("inputs", "hidden", "to_class", "class_bias", "to_word", "word_bias")


def places_of(states: np.ndarray) -> np.ndarray:
    """(steps, units, rows) as (units, places)."""
    return states.transpose(0, 2, 1).reshape(-1, states.shape[1]).T


def stretches(low: int, high: int) -> list[tuple[int, int]]:
    return [(a, min(a + STRETCH, high)) for a in range(low, high, STRETCH)]


def log_mass(x: np.ndarray, at: np.ndarray, shift: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of scores ``x`` (choices, places) those of the targets ``at``, and the sums of all in powers of e; ``x`` is overwritten by the powers.

    With ``shift`` scores count from each place's greatest.
    """
    if shift:
        x -= x.max(axis=0)
    aim = x[at, np.arange(x.shape[1])]
    np.exp(x, out=x)
    return aim, x.sum(axis=0)


def may_overflow(weights: np.ndarray) -> bool:
    """Whether scores by these ``weights`` (choices, units and bias) can leave what powers of e hold with ease; units are within -1 and 1."""
    return float(np.abs(weights).sum(axis=1).max()) > 40


@dataclass
class Gru:
    """Inputs are numbers 0..n_inputs-1: head words, then tail classes, then the start."""

    inputs: np.ndarray  # (n_inputs, 3H)
    hidden: np.ndarray  # (H, 3H)
    to_class: np.ndarray  # (H, C)
    class_bias: np.ndarray
    to_word: np.ndarray  # (K, H), rows of a class together
    word_bias: np.ndarray
    bounds: np.ndarray  # head class c has words bounds[c]..bounds[c+1]

    @property
    def size(self) -> int:
        return self.hidden.shape[0]

    @classmethod
    def fresh(cls, bounds: np.ndarray, n_tail: int, log_class: np.ndarray, log_word: np.ndarray, size: int, seed: int) -> "Gru":
        rng = np.random.default_rng(seed)
        n_words, n_classes = int(bounds[-1]), len(bounds) - 1 + n_tail

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.1).astype(F32)

        return cls(
            small(n_words + n_tail + 1, 3 * size), small(size, 3 * size), small(size, n_classes),
            log_class.astype(F32), small(n_words, size), log_word.astype(F32), bounds,
        )

    def flat(self) -> np.ndarray:
        """All weights in a row."""
        return np.concatenate([getattr(self, k).ravel() for k in WEIGHTS])

    def copy(self, flat: np.ndarray | None = None) -> "Gru":
        """A network of its own, of the same weights or of ``flat``."""
        rest, parts = self.flat() if flat is None else flat, []
        for k in WEIGHTS:
            held = getattr(self, k)
            parts.append(rest[: held.size].reshape(held.shape).astype(F32))
            rest = rest[held.size :]
        return Gru(*parts, self.bounds)

    @staticmethod
    def updates_for(n: int, rows: int = 64, steps: int = 32) -> int:
        """Updates in which ``train`` reads each of ``n`` places."""
        return max(1, -(-(-(-n // rows)) // steps))

    def by_gate(self, weights: np.ndarray) -> np.ndarray:
        """(n, 3H) as (3, n, H)."""
        return np.ascontiguousarray(weights.reshape(len(weights), 3, self.size).transpose(1, 0, 2))

    def run(self, tokens: np.ndarray, h: np.ndarray, keep: list | None = None, goes_on: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """States (steps, units, rows) after each of ``tokens`` (steps, rows), and the last; ``keep`` gets what the backward pass needs.

        ``goes_on`` (steps, rows) is 0 where a text begins, which clears the state.
        """
        inputs, across = self.by_gate(self.inputs), self.by_gate(self.hidden)
        # gates are 1 / (1 + exp(-x)): numpy's exp takes less time than its tanh
        inputs[:2] *= -1
        across[:2] *= -1
        h = np.ascontiguousarray(h.T, dtype=F32)
        out = np.empty((*tokens.shape, self.size), dtype=F32)
        with np.errstate(over="ignore"):  # a gate of 0
            for t in range(len(tokens)):
                x = inputs.take(tokens[t], axis=1)
                if goes_on is not None and not goes_on[t].all():
                    h = h * goes_on[t][:, None]
                u = np.matmul(h, across)
                gates, un = u[:2], u[2]
                gates += x[:2]
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                n = gates[1] * un
                n += x[2]
                np.tanh(n, out=n)
                new = np.subtract(h, n, out=out[t])
                new *= gates[0]
                new += n
                if keep is not None:
                    keep.append((h, gates, n, un))
                h = new
        return out.transpose(0, 2, 1), h.T

    def back(self, tokens: np.ndarray, kept: list, d_out: np.ndarray, goes_on: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the inputs and of the hidden weights; ``d_out`` is (steps, units, rows)."""
        size, (steps, rows) = self.size, tokens.shape
        d_out, to_state = np.ascontiguousarray(d_out.transpose(0, 2, 1)), self.by_gate(self.hidden).transpose(0, 2, 1)
        d_x = np.empty((3, steps, rows, size), dtype=F32)
        d_u = np.empty((3, rows, size), dtype=F32)
        d_hidden = np.zeros((3, size, size), dtype=F32)
        dh = np.zeros((rows, size), dtype=F32)
        for t in range(steps - 1, -1, -1):
            h, gates, n, un = kept[t]
            dh += d_out[t]
            slope, dn = d_u[:2], d_u[2]
            np.subtract(1, gates, out=slope)
            np.multiply(n, n, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= slope[0]
            dn *= dh
            slope *= gates
            slope[0] *= h - n
            slope[0] *= dh
            slope[1] *= un
            slope[1] *= dn
            d_x[:, t] = d_u
            dn *= gates[1]
            d_hidden += np.matmul(h.T, d_u)
            dh *= gates[0]
            for part in np.matmul(d_u, to_state):
                dh += part
            if not goes_on[t].all():
                dh *= goes_on[t][:, None]
        # sums by token: sorted, then one sum for each stretch of equal tokens
        flat, d_in = tokens.ravel(), np.zeros_like(self.inputs)
        order = self.sorted_by(flat, len(self.inputs))
        of = flat[order]
        first = np.concatenate([[0], np.nonzero(of[1:] != of[:-1])[0] + 1])
        for k in range(3):
            d_in[of[first], k * size : (k + 1) * size] = np.add.reduceat(d_x[k].reshape(-1, size).take(order, axis=0), first, axis=0)
        return {"inputs": d_in, "hidden": d_hidden.transpose(1, 0, 2).reshape(size, 3 * size)}

    @staticmethod
    def sorted_by(numbers: np.ndarray, below: int) -> np.ndarray:
        """Places in the order of their numbers, equal ones as they come; short integers are sorted by their digits."""
        return np.argsort(numbers.astype(np.int16) if below < 1 << 15 else numbers, kind="stable")

    def by_class(self, classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
        """The places in the order of their classes, and for head classes of several words: the stretch of that order and the words."""
        order = self.sorted_by(classes, len(self.class_bias))
        cuts = np.searchsorted(classes[order], np.arange(len(self.bounds)))
        parts = [(int(cuts[c]), int(cuts[c + 1]), int(self.bounds[c]), int(self.bounds[c + 1])) for c in range(len(self.bounds) - 1)]
        return order, [p for p in parts if p[1] > p[0] and p[3] - p[2] > 1]

    def with_ones(self, states: np.ndarray, order: np.ndarray) -> np.ndarray:
        """(places, units and one) of ``states`` (units, places) in this order; the one meets the bias."""
        held = np.ones((len(order), self.size + 1), dtype=F32)
        held[:, :-1] = states.T.take(order, axis=0)
        return held

    def outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias by class and by word, (choices, units and one)."""
        return np.vstack([self.to_class, self.class_bias]).T.copy(), np.column_stack([self.to_word, self.word_bias])

    def log_probs(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Natural log of each target's class and, for head words, of the word in its class. ``words`` is -1 in tail classes; states are (units, places)."""
        order, parts = self.by_class(classes)
        held, classes, words = self.with_ones(states, order), classes[order], words[order]
        found, (by_class, by_word) = np.zeros(len(order)), self.outputs()

        def add(weights: np.ndarray, a: int, b: int, at: np.ndarray, shift: bool) -> None:
            aim, mass = log_mass(weights @ held[a:b].T, at, shift)
            found[a:b] += aim - np.log(mass)

        shift = may_overflow(by_class)
        for a, b in stretches(0, len(order)):
            add(by_class, a, b, classes[a:b], shift)
        for begin, end, low, high in parts:
            shift = may_overflow(by_word[low:high])
            for a, b in stretches(begin, end):
                add(by_word[low:high], a, b, words[a:b] - low, shift)
        out = np.empty_like(found)
        out[order] = found
        return out

    def loss_back(self, states: np.ndarray, classes: np.ndarray, words: np.ndarray) -> tuple[float, np.ndarray, dict[str, np.ndarray]]:
        """Mean loss of the targets, its gradient by state (units, places), and by the output weights."""
        n = len(classes)
        order, parts = self.by_class(classes)
        held, classes, words = self.with_ones(states, order), classes[order], words[order]
        d_held = np.zeros((n, self.size), dtype=F32)
        by_class, by_word = self.outputs()
        d_class, d_word = np.zeros_like(by_class), np.zeros_like(by_word)

        def sloped(weights: np.ndarray, a: int, b: int, at: np.ndarray, shift: bool, d_weights: np.ndarray) -> float:
            """Loss of the targets ``at``; adds its gradients by the weights and by the states."""
            x = weights @ held[a:b].T
            aim, mass = log_mass(x, at, shift)
            loss = float((np.log(mass) - aim).sum(dtype=np.float64))
            mass *= n
            x *= np.reciprocal(mass, out=mass)
            x[at, np.arange(b - a)] -= F32(1 / n)
            d_weights += x @ held[a:b]
            d_held[a:b] += x.T @ weights[:, :-1]
            return loss

        shift, total = may_overflow(by_class), 0.0
        for a, b in stretches(0, n):
            total += sloped(by_class, a, b, classes[a:b], shift, d_class)
        for begin, end, low, high in parts:
            shift = may_overflow(by_word[low:high])
            for a, b in stretches(begin, end):
                total += sloped(by_word[low:high], a, b, words[a:b] - low, shift, d_word[low:high])
        d_states = np.empty_like(d_held)
        d_states[order] = d_held
        grads = {"to_class": d_class[:, :-1].T, "class_bias": d_class[:, -1], "to_word": d_word[:, :-1], "word_bias": d_word[:, -1]}
        return total / n, d_states.T, grads

    def train(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], updates: int, rows: int = 64, steps: int = 32, rate: float = 0.01, seed: int = 1) -> float:
        """Adam over windows of ``steps``; each row reads one text after the other and carries its state from window to window.

        A text is (inputs, classes, words). Returns the mean loss of the last tenth.
        """
        rng = np.random.default_rng(seed)
        lanes = [np.concatenate(part) for part in zip(*[texts[i] for i in rng.permutation(len(texts))])]
        # every row starts elsewhere in the same long sequence
        length = len(lanes[0])
        place = (np.arange(rows) * (length / rows)).astype(np.int64)
        start = int(self.inputs.shape[0] - 1)
        h = np.zeros((self.size, rows), dtype=F32)
        names = WEIGHTS
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        late: list[float] = []
        for update in range(1, updates + 1):
            at = (place[None, :] + np.arange(steps)[:, None]) % length
            tokens, classes, words = (lane[at] for lane in lanes)
            goes_on = (tokens != start).astype(F32)
            kept: list = []
            states, last = self.run(tokens, h, kept, goes_on)
            loss, d_states, grads = self.loss_back(places_of(states), classes.ravel(), words.ravel())
            grads |= self.back(tokens, kept, d_states.T.reshape(steps, rows, self.size).transpose(0, 2, 1), goes_on)
            step_rate = rate * min(1.0, 2.0 * (1 - (update - 1) / updates))
            for k in names:
                g, held = np.clip(grads[k], -1, 1), getattr(self, k)
                m[k] *= 0.9
                m[k] += 0.1 * g
                g *= g
                g *= 0.001
                v[k] *= 0.999
                v[k] += g
                np.sqrt(v[k], out=g)
                g *= 1 / math.sqrt(1 - 0.999**update)
                g += 1e-8
                np.divide(m[k], g, out=g)
                g *= step_rate / (1 - 0.9**update)
                held -= g
            h, place = last, (place + steps) % length
            if update > 0.9 * updates:
                late.append(loss)
        return float(np.mean(late))

    def score(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], rows: int = 512, steps: int = 32) -> np.ndarray:
        """Natural log probability of each whole text. Each row reads one text after the other, in windows of ``steps``, the state carried across.

        A text goes to the row that has least so far, the longest first, so that rows end at about the same place.
        """
        lengths = np.array([len(text[0]) for text in texts], dtype=np.int64)
        least = [(0, row) for row in range(max(1, min(rows, int(lengths.sum() // lengths.max()))))]
        read: list[list[int]] = [[] for _ in least]
        for k in np.argsort(-lengths, kind="stable").tolist():
            held, row = least[0]
            read[row].append(k)
            heapq.heapreplace(least, (held + int(lengths[k]), row))
        read.sort(key=lambda row: -sum(lengths[row]))
        size = np.array([lengths[row].sum() for row in read])
        begin, order = np.cumsum(size) - size, np.concatenate(read)
        inputs, classes, words = (np.concatenate(part) for part in zip(*[texts[k] for k in order]))
        of = np.repeat(order.astype(np.int32), lengths[order])
        out, h, start = np.zeros(len(texts)), np.zeros((self.size, len(size)), dtype=F32), len(self.inputs) - 1
        for low in range(0, int(size[0]), steps):
            live = int((size > low).sum())
            place = low + np.arange(min(steps, int(size[0]) - low))[:, None]
            used = place < size[:live]
            at = np.where(used, begin[:live] + place, 0)
            tokens = inputs[at]
            states, h = self.run(tokens, h[:, :live], goes_on=(tokens != start).astype(F32))
            places, flat = places_of(states), at.ravel()
            if not used.all():
                held = np.nonzero(used.ravel())[0]
                places, flat = places.T.take(held, axis=0).T, flat[held]
            lp = self.log_probs(places, classes[flat], words[flat])
            out += np.bincount(of[flat], weights=lp, minlength=len(out))
        return out
