"""All runs of a sequence of numbers, after Gusfield and Stoye's linear tandem-repeat method.

1. Blocks: the sequence is cut as by Lempel and Ziv, each block being the longest
   one that also begins earlier. The leftmost occurrence of every square touches
   the border of a block with a period bounded by the blocks there, so extending
   both ways from the borders finds a square of every kind, or one from which it is reached.
2. Vocabulary: each square found is marked in the suffix tree, where it is an
   interval of sorted suffixes and a depth. From a mark the suffix link leads to
   the square turned by one letter, if the letter that left can follow; this
   goes on until a known mark is met.
3. Runs: the suffixes below a mark are all places of that square; squares of one
   period at neighbouring places merge into a run.

The suffix tree is held as sorted suffixes with names for all stretches of 1, 2,
4 ... letters. Equal stretches have equal names, so two places are extended
either way in a logarithm of steps, for all pairs at once.
"""

from __future__ import annotations

import numpy as np


class Suffixes:
    """``letters`` with their sorted suffixes (``order``, ``rank``) and common prefixes of neighbours."""

    def __init__(self, letters: np.ndarray):
        self.n = n = len(letters)
        _, name = np.unique(letters, return_inverse=True)
        names, width = [name.astype(np.int64)], 1
        while names[-1].max(initial=0) < n - 1:
            left, right = names[-1], np.zeros(n, np.int64)
            right[: max(0, n - width)] = left[width:] + 1  # 0: the text ends before
            _, name = np.unique(left * (n + 1) + right, return_inverse=True)
            names.append(name.astype(np.int64))
            width *= 2
        self.rank = names[-1]
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        # a place past the end has a name of its own; names of stretches cut by the end differ from all others
        self.names = np.full((len(names), n + 1), -1, np.int32)
        self.names[:, :n] = names
        common = np.zeros(n, np.int64)
        common[1:] = self.forward(self.order[:-1], self.order[1:])
        self.floors = [common]  # least common prefix over 1, 2, 4 ... neighbours
        step = 1
        while 2 * step <= n:
            held = self.floors[-1]
            self.floors.append(np.minimum(held[:-step], held[step:]))
            step *= 2

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters from ``a`` and ``b`` (different places) on are equal."""
        out = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.names))):
            names = self.names[k]
            out += (names[a + out] == names[b + out]).astype(np.int64) << k
        return out

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many letters up to ``a`` and ``b``, these included, are equal; places may be -1."""
        out, low = np.zeros(len(a), np.int64), np.minimum(a, b)
        for k in reversed(range(len(self.names))):
            names, back = self.names[k], out + (1 << k) - 1
            fits = low >= back
            out += ((names[np.where(fits, a - back, 0)] == names[np.where(fits, b - back, 0)]) & fits).astype(np.int64) << k
        return out

    def interval(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted suffixes that share their first ``depth`` letters with the suffix ``at``: first and one past the last."""
        low, high = self.rank[at].copy(), self.rank[at].copy()
        for k in reversed(range(len(self.floors))):
            floor, step = self.floors[k], 1 << k
            start = low - step + 1  # of the neighbours low - step .. low
            fits = (start >= 1) & (floor[np.clip(start, 0, len(floor) - 1)] >= depth)
            low -= fits * step
            fits = (high + step <= self.n - 1) & (floor[np.clip(high + 1, 0, len(floor) - 1)] >= depth)
            high += fits * step
        return low, high + 1

    def followed(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Of suffixes low..high that share ``depth`` letters, the first whose next letter is ``letter``; -1 if there is none."""
        first, end, last = low.copy(), high.copy(), self.n
        letters = self.names[0]
        while True:
            going = first < end
            if not going.any():
                break
            middle = (first + end) // 2
            less = going & (letters[np.minimum(self.order[np.minimum(middle, last - 1)] + depth, last)] < letter)
            first, end = np.where(less, middle + 1, first), np.where(going & ~less, middle, end)
        there = np.minimum(first, last - 1)
        met = (first < high) & (letters[np.minimum(self.order[there] + depth, last)] == letter)
        return np.where(met, there, -1)


def blocks(of: Suffixes) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, with the end."""
    n = of.n
    # taking places out from the last on, the neighbours of a place among the sorted suffixes are the nearest that begin before it
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    left, right, rank = [0] * n, [0] * n, of.rank.tolist()
    for i in range(n - 1, -1, -1):
        r = rank[i]
        a, b = before[r], after[r]
        left[i], right[i] = a, b
        if a >= 0:
            after[a] = b
        if b < n:
            before[b] = a
    at, longest = np.arange(n), np.zeros(n, np.int64)
    for side in (np.array(left), np.array(right)):
        some = (side >= 0) & (side < n)
        longest[some] = np.maximum(longest[some], of.forward(at[some], of.order[side[some]]))
    sizes, starts, h = np.maximum(longest, 1).tolist(), [], 0
    while h < n:
        starts.append(h)
        h += sizes[h]
    return np.array([*starts, n])


def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes 2, 3: which one (0, 0, 1, 1, 1) and the number in it (0, 1, 0, 1, 2)."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def primitive(of: Suffixes, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the stretches (of two periods at least) have no smaller period: one would divide theirs."""
    out = np.ones(len(start), bool)
    most = int(period.max(initial=1))
    rest = period.copy()
    for p in range(2, int(most**0.5) + 2):
        divides = rest % p == 0
        if divides.any():
            some = np.flatnonzero(divides)
            part = period[some] // p
            out[some] &= of.forward(start[some], start[some] + part) < (end - start)[some] - part
            while len(some):
                rest[some] //= p
                some = some[rest[some] % p == 0]
    some = np.flatnonzero(rest > 1)
    part = period[some] // rest[some]
    out[some] &= of.forward(start[some], start[some] + part) < (end - start)[some] - part
    return out


def bordering(of: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (start, end, smallest period) of two periods at least that touch a block's border, as far as they reach."""
    cuts = blocks(of)
    size = np.diff(cuts)
    found = []
    # back from a block's end, by periods up to its length
    owner, k = counted(size)
    k += 1
    at = cuts[1:][owner]
    at, k = at[at < of.n], k[at < of.n]
    found.append((at - k, at, k))
    # on from a block's start, by periods up to its length and the next one's
    owner, k = counted(size + np.append(size[1:], 0))
    k += 1
    at = cuts[:-1][owner]
    fits = (at > 0) & (at + k < of.n)
    found.append((at[fits], at[fits] + k[fits], k[fits]))
    a, b, k = (np.concatenate(c) for c in zip(*found))
    same = of.names[0][a] == of.names[0][b]
    same |= (a > 0) & (of.names[0][np.maximum(a - 1, 0)] == of.names[0][b - 1])
    a, b, k = a[same], b[same], k[same]
    right, left = of.forward(a, b), of.backward(a - 1, b - 1)
    square = right + left >= k
    start, end, k = (a - left)[square], (b + right)[square], k[square]
    _, once = np.unique(start * (of.n + 1) + k, return_index=True)
    start, end, k = start[once], end[once], k[once]
    least = primitive(of, start, end, k)
    return start[least], end[least], k[least]


def vocabulary(of: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """One mark (first sorted suffix, period) for every kind of square with a primitive half."""
    start, end, k = bordering(of)
    places = end - start - 2 * k + 1
    owner, turn = counted(np.minimum(places, k))
    low, _ = of.interval(start[owner] + turn, 2 * k[owner])
    marks = np.unique(low * (of.n + 1) + k[owner])
    # all turns of a stretch that holds three periods are marked already; elsewhere go on from the last
    ends = np.flatnonzero(places < k)
    at, period = start[ends] + places[ends] - 1, k[ends]
    while len(at):
        low, high = of.interval(at + 1, 2 * period - 1)
        first = of.followed(low, high, 2 * period - 1, of.names[0][at])
        met = first >= 0
        made, where = np.unique(first[met] * (of.n + 1) + period[met], return_index=True)
        known = np.minimum(np.searchsorted(marks, made), max(0, len(marks) - 1))
        new = marks[known] != made
        made = made[new]
        marks = np.sort(np.concatenate([marks, made]))
        at, period = of.order[made // (of.n + 1)], made % (of.n + 1)
    return marks // (of.n + 1), marks % (of.n + 1)


def runs(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, length and smallest period of every run: of two periods at least, and no longer stretch around it has that period."""
    none = np.zeros(0, np.int64)
    if len(letters) < 2:
        return none, none, none
    of = Suffixes(letters)
    first, k = vocabulary(of)
    if not len(k):
        return none, none, none
    low, high = of.interval(of.order[first], 2 * k)
    owner, nth = counted(high - low)
    start, k = of.order[low[owner] + nth], k[owner]
    by = np.lexsort((start, k))
    start, k = start[by], k[by]
    begins = np.ones(len(start), bool)
    begins[1:] = (k[1:] != k[:-1]) | (start[1:] != start[:-1] + 1)
    heads = np.flatnonzero(begins)
    last = np.append(heads[1:], len(start)) - 1
    return start[heads], start[last] - start[heads] + 2 * k[heads], k[heads]
