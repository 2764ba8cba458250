"""A character-level bidirectional LSTM with CRF transitions, in numpy.

States are held as (units, rows), so each gate is one stretch of memory and a
step is a gather, a product and a few vector operations over all rows.
"""

from __future__ import annotations

import numpy as np

F32 = np.float32


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Tag 0 is outside. Gates lie in the order input, forget, output, candidate."""

    def __init__(self, symbols: int, tags: int, units: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.units, self.tags = units, tags

        def small(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * 0.3).astype(F32)

        self.weights = {}
        for side in "fb":
            self.weights[f"x{side}"] = small(symbols, 4 * units)
            self.weights[f"x{side}"][:, units : 2 * units] += 1  # remember at first
            self.weights[f"u{side}"] = small(4 * units, units)
            self.weights[f"o{side}"] = small(tags, units)
        self.weights["bias"] = np.zeros(tags, dtype=F32)
        self.weights["trans"] = np.zeros((tags, tags), dtype=F32)  # from, to

    def _pass(self, codes: np.ndarray, side: str, emit: np.ndarray, keep: list | None = None) -> None:
        """Add what one direction says to ``emit`` (steps, tags, rows)."""
        n, w = self.units, self.weights
        table, u, out = w[f"x{side}"].copy(), w[f"u{side}"].copy(), w[f"o{side}"]
        table[:, : 3 * n] *= 0.5  # a logistic is half a tanh of the half
        u[: 3 * n] *= 0.5
        steps, rows = codes.shape
        h, c = np.zeros((n, rows), F32), np.zeros((n, rows), F32)
        gates, part = np.empty((4 * n, rows), F32), np.empty((4 * n, rows), F32)
        x, top, said = np.empty((rows, 4 * n), F32), np.empty((n, rows), F32), np.empty((self.tags, rows), F32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            np.take(table, codes[t], axis=0, out=x, mode="clip")
            np.matmul(u, h, out=part)
            np.add(x.T, part, out=gates)
            np.tanh(gates, out=gates)
            soft = gates[: 3 * n]
            soft *= 0.5
            soft += 0.5
            if keep is not None:
                keep.append((t, h.copy(), c.copy(), gates.copy()))
                i, f, o, g = (gates[k * n : (k + 1) * n] for k in range(4))
                c = f * c + i * g
                np.tanh(c, out=top)
                h = o * top
                keep[-1] += (top.copy(), h)
            else:
                c *= soft[n : 2 * n]
                soft[:n] *= gates[3 * n :]
                c += soft[:n]
                np.tanh(c, out=top)
                np.multiply(soft[2 * n :], top, out=h)
            np.matmul(out, h, out=said)
            emit[t] += said

    def emissions(self, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """(steps, tags, rows) for codes (steps, rows)."""
        emit = np.empty((codes.shape[0], self.tags, codes.shape[1]), F32)
        emit[:] = self.weights["bias"][None, :, None]
        for side in "fb":
            self._pass(codes, side, emit, None if keep is None else keep.setdefault(side, []))
        return emit

    def may_hold(self, emit: np.ndarray) -> np.ndarray:
        """Rows whose best path may leave tag 0.

        The best gain of any stretch of other tags over staying outside is bounded
        from above, whatever its tags; where the bound is not over zero, the path
        outside is the best one.
        """
        trans = self.weights["trans"]
        enter = trans[0, 1:].max() - trans[0, 0]
        inside, leave = trans[1:, 1:].max() - trans[0, 0], max(0.0, trans[1:, 0].max() - trans[0, 0])
        over = emit[:, 1:].max(axis=1) - emit[:, 0]
        gain = np.full(emit.shape[2], -np.inf, F32)
        most = gain.copy()
        first = max(enter, inside, 0.0)  # a row may begin inside
        for t in range(len(emit)):
            gain = np.maximum(gain + inside, first if t == 0 else enter) + over[t]
            most = np.maximum(most, gain)
        return most + leave > 0

    def decode(self, emit: np.ndarray) -> np.ndarray:
        """The best path of each row: (steps, rows)."""
        trans = self.weights["trans"]
        steps, tags, rows = emit.shape
        score, back = emit[0].copy(), np.empty((steps, tags, rows), np.int8)
        for t in range(1, steps):
            options = score[:, None, :] + trans[:, :, None]
            back[t] = options.argmax(axis=0)
            score = options.max(axis=0) + emit[t]
        path = np.empty((steps, rows), np.int8)
        path[-1] = score.argmax(axis=0)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][None].astype(np.int64), axis=0)[0]
        return path

    def loss_back(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        kept: dict = {}
        emit = self.emissions(codes, kept)
        steps, tags, rows = emit.shape
        trans = self.weights["trans"]
        ahead, behind = np.empty_like(emit), np.zeros_like(emit)
        ahead[0] = emit[0]
        for t in range(1, steps):
            ahead[t] = _sum_exp(ahead[t - 1][:, None, :] + trans[:, :, None], 0) + emit[t]
        for t in range(steps - 2, -1, -1):
            behind[t] = _sum_exp(trans[:, :, None] + (emit[t + 1] + behind[t + 1])[None], 1)
        z = _sum_exp(ahead[-1], 0)
        d = np.exp(ahead + behind - z)
        every = np.arange(rows)
        gold_score = sum(emit[t][gold[t], every] for t in range(steps)) + sum(trans[gold[t - 1], gold[t]] for t in range(1, steps))
        for t in range(steps):
            d[t][gold[t], every] -= 1
        grads = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for t in range(1, steps):
            pair = np.exp(ahead[t - 1][:, None, :] + trans[:, :, None] + (emit[t] + behind[t])[None] - z)
            grads["trans"] += pair.sum(axis=2)
            np.add.at(grads["trans"], (gold[t - 1], gold[t]), -1)
        d /= rows
        grads["trans"] /= rows
        grads["bias"] = d.sum(axis=(0, 2))
        n = self.units
        for side in "fb":
            u, out = self.weights[f"u{side}"], self.weights[f"o{side}"]
            dh, dc = np.zeros((n, rows), F32), np.zeros((n, rows), F32)
            for t, h0, c0, gates, top, h1 in reversed(kept[side]):
                i, f, o, g = (gates[k * n : (k + 1) * n] for k in range(4))
                grads[f"o{side}"] += d[t] @ h1.T
                dh = dh + out.T @ d[t]
                dc = dc + dh * o * (1 - top * top)
                raw = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * top * o * (1 - o), dc * i * (1 - g * g)])
                np.add.at(grads[f"x{side}"], codes[t], raw.T)
                grads[f"u{side}"] += raw @ h0.T
                dh, dc = u.T @ raw, dc * f
        return float((z - gold_score).mean()), grads

    def train(self, draw, updates: int, rate: float = 0.03) -> float:
        """Adam; ``draw(k)`` gives the k-th (codes, gold). Returns the mean loss of the last tenth."""
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        late = []
        for k in range(1, updates + 1):
            loss, grads = self.loss_back(*draw(k))
            step = rate * min(1.0, 2.0 * (1 - (k - 1) / updates))
            for name, g in grads.items():
                g = np.clip(g, -5, 5)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                self.weights[name] -= (step * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.99**k)) + 1e-8)).astype(F32)
            if k > 0.9 * updates:
                late.append(loss)
        return float(np.mean(late))
