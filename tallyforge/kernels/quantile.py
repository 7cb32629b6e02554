"""Mergeable quantile summaries: KLL over any ordered items, REQ and t-digest over doubles.

All are seeded, so that the same input in the same order gives the same summary. Each
has to_bytes and from_bytes for shipping between tasks.
"""

from __future__ import annotations

import json
import math
import struct
from bisect import bisect_left, bisect_right

import numpy as np


class SortedView:
    """Items in order with the weight up to and including each."""

    def __init__(self, items: list, weights: list[int]):
        order = sorted(range(len(items)), key=items.__getitem__)
        self.items = [items[i] for i in order]
        self.upto = np.cumsum([weights[i] for i in order]).tolist() if items else []

    @property
    def n(self) -> int:
        return self.upto[-1] if self.upto else 0

    def rank(self, item, inclusive: bool = True) -> float:
        at = (bisect_right if inclusive else bisect_left)(self.items, item)
        return self.upto[at - 1] / self.n if at else 0.0

    def quantile(self, rank: float, inclusive: bool = True):
        if not 0.0 <= rank <= 1.0:
            raise ValueError("a rank lies between 0 and 1")
        place = rank * self.n
        if self.n <= 10_000_000:
            place = round(place * 1e7) / 1e7
        at = bisect_left(self.upto, math.ceil(place)) if inclusive else bisect_right(self.upto, math.floor(place))
        return self.items[min(at, len(self.items) - 1)]

    def cdf(self, splits: list, inclusive: bool = True) -> list[float]:
        if any(not a < b for a, b in zip(splits, splits[1:], strict=False)):
            raise ValueError("split points must increase")
        return [*(self.rank(s, inclusive) for s in splits), 1.0]

    def pmf(self, splits: list, inclusive: bool = True) -> list[float]:
        c = self.cdf(splits, inclusive)
        return [c[0], *(b - a for a, b in zip(c, c[1:], strict=False))]

    def boundaries(self, parts: int) -> list:
        return [self.quantile(i / parts) for i in range(parts + 1)]


class _Summary:
    """What the three share: an answer comes from a sorted view."""

    def view(self) -> SortedView:
        raise NotImplementedError

    def quantile(self, rank: float, inclusive: bool = True):
        return self.view().quantile(rank, inclusive)

    def rank(self, item, inclusive: bool = True) -> float:
        return self.view().rank(item, inclusive)

    def cdf(self, splits, inclusive: bool = True):
        return self.view().cdf(splits, inclusive)

    def pmf(self, splits, inclusive: bool = True):
        return self.view().pmf(splits, inclusive)


class Kll(_Summary):
    """Levels of items of weight 2**level; a full level gives half of its sorted items to the next."""

    M = 8

    def __init__(self, k: int = 200, seed: int = 1):
        if not self.M <= k <= 65535:
            raise ValueError("k is out of range")
        self.k = self.min_k = k
        self.n = 0
        self.levels: list[list] = [[]]
        self.low = self.high = None
        self.state = seed

    def _coin(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        return self.state >> 63

    def _capacity(self, level: int) -> int:
        return max(self.M, round(self.k * (2 / 3) ** (len(self.levels) - 1 - level)))

    def extend(self, items) -> Kll:
        new = [x for x in items if x is not None and x == x]
        if not new:
            return self
        self.low = min(new) if self.low is None else min(self.low, min(new))
        self.high = max(new) if self.high is None else max(self.high, max(new))
        self.n += len(new)
        step = max(1, self.k)
        for at in range(0, len(new), step):
            self.levels[0] += new[at : at + step]
            self._shrink()
        return self

    def _shrink(self) -> None:
        while sum(map(len, self.levels)) > sum(self._capacity(i) for i in range(len(self.levels))):
            at = next(i for i, x in enumerate(self.levels) if len(x) >= self._capacity(i))
            if at == len(self.levels) - 1:
                self.levels.append([])
            items = sorted(self.levels[at])
            self.levels[at] = [items.pop()] if len(items) % 2 else []
            self.levels[at + 1] += items[self._coin() :: 2]

    def merge(self, other: Kll) -> Kll:
        if other.n == 0:
            return self
        self.low = other.low if self.low is None else min(self.low, other.low)
        self.high = other.high if self.high is None else max(self.high, other.high)
        self.n += other.n
        if len(other.levels) > 1:
            self.min_k = min(self.min_k, other.min_k)
        for i, x in enumerate(other.levels):
            if i == len(self.levels):
                self.levels.append([])
            self.levels[i] += x
        self._shrink()
        return self

    def view(self) -> SortedView:
        items = [x for level in self.levels for x in level]
        weights = [1 << i for i, level in enumerate(self.levels) for _ in level]
        v = SortedView(items, weights)
        if v.items:  # the ends are always true
            v.items[0], v.items[-1] = self.low, self.high
        return v

    def to_bytes(self) -> bytes:
        return json.dumps([self.k, self.min_k, self.n, self.low, self.high, self.state, self.levels]).encode()

    @classmethod
    def from_bytes(cls, data: bytes) -> Kll:
        out = cls()
        out.k, out.min_k, out.n, out.low, out.high, out.state, out.levels = json.loads(data)
        return out


class Req(_Summary):
    """Relative-error quantiles: sorted buffers that give items up from the inaccurate end only.

    A level has room for twice its sections of k items each. The half at the accurate end is
    never touched. A compaction takes all of the other half but some sections next to the
    protected one: how many it takes follows the ruler sequence 1, 2, 1, 3, 1, 2, 1, 4, ...,
    so that a section is taken half as often as the one farther out. The number of sections
    grows with the logarithm of what a level has seen.
    """

    LEAST_SECTIONS = 3

    def __init__(self, k: int = 12, high: bool = True, seed: int = 1):
        if not 4 <= k <= 1024 or k % 2:
            raise ValueError("k must be even and lie between 4 and 1024")
        self.k, self.high, self.n = k, high, 0
        self.rng = np.random.Generator(np.random.PCG64(seed))
        self.low_item, self.high_item = math.inf, -math.inf
        #: For each level: items, compactions so far, items that ever came in.
        self.items: list[np.ndarray] = []
        self.rounds: list[int] = []
        self.seen: list[int] = []

    def _sections(self, level: int) -> int:
        return max(self.LEAST_SECTIONS, math.ceil(math.log2(max(1, self.seen[level]) / self.k)))

    def _put(self, level: int, new: np.ndarray, seen: int) -> None:
        if level == len(self.items):
            self.items.append(np.zeros(0))
            self.rounds.append(0)
            self.seen.append(0)
        self.items[level] = np.sort(np.concatenate([self.items[level], new]), kind="stable")
        self.seen[level] += seen

    def extend(self, values) -> Req:
        v = np.asarray(values, np.float64)
        v = v[np.isfinite(v)]
        if not len(v):
            return self
        self.low_item, self.high_item = min(self.low_item, float(v.min())), max(self.high_item, float(v.max()))
        self.n += len(v)
        step = 4 * self.k * self.LEAST_SECTIONS
        for at in range(0, len(v), step):
            part = v[at : at + step]
            self._put(0, part, len(part))
            self._settle()
        return self

    def _settle(self) -> None:
        for level in range(64):
            if level == len(self.items):
                return
            sections = self._sections(level)
            while len(self.items[level]) >= 2 * self.k * sections:
                self._give_up(level, sections)

    def _give_up(self, level: int, sections: int) -> None:
        self.rounds[level] += 1
        ruler = (self.rounds[level] & -self.rounds[level]).bit_length()
        stay = self.k * (2 * sections - min(ruler, sections))
        own = self.items[level]
        gone = (len(own) - stay) // 2 * 2
        part, rest = (own[:gone], own[gone:]) if self.high else (own[len(own) - gone :], own[: len(own) - gone])
        self.items[level] = rest
        # one of every two neighbours goes up, for both
        self._put(level + 1, part.reshape(-1, 2)[:, int(self.rng.integers(2))], gone // 2)

    def merge(self, other: Req) -> Req:
        """Level by level; what a level has seen adds up, and of two rulers the one further on holds."""
        if self.high != other.high:
            raise ValueError("only summaries of the same accurate end merge")
        self.low_item, self.high_item = min(self.low_item, other.low_item), max(self.high_item, other.high_item)
        self.n += other.n
        for level, (items, rounds, seen) in enumerate(zip(other.items, other.rounds, other.seen, strict=True)):
            self._put(level, items, seen)
            self.rounds[level] = max(self.rounds[level], rounds)
        self._settle()
        return self

    def view(self) -> SortedView:
        return SortedView([float(x) for level in self.items for x in level], [1 << i for i, level in enumerate(self.items) for _ in level])

    def rank(self, item, inclusive: bool = True) -> float:
        if not math.isfinite(item):
            raise ValueError("a finite item is asked for")
        return super().rank(item, inclusive)

    _HEAD = struct.Struct("<4sHBBQQdd")

    def to_bytes(self) -> bytes:
        """Magic, k, accurate end, levels, n, a seed for what follows, ends; for each level its numbers and items."""
        head = self._HEAD.pack(b"TFRQ", self.k, self.high, len(self.items), self.n, int(self.rng.integers(1 << 62)), self.low_item, self.high_item)
        return head + b"".join(struct.pack("<QQI", r, s, len(x)) + x.astype("<f8").tobytes() for r, s, x in zip(self.rounds, self.seen, self.items, strict=True))

    @classmethod
    def from_bytes(cls, data: bytes) -> Req:
        magic, k, high, levels, n, seed, low_item, high_item = cls._HEAD.unpack_from(data)
        if magic != b"TFRQ":
            raise ValueError("not a relative-error summary")
        out, at = cls(k, bool(high), seed), cls._HEAD.size
        out.n, out.low_item, out.high_item = n, low_item, high_item
        for level in range(levels):
            rounds, seen, size = struct.unpack_from("<QQI", data, at)
            out._put(level, np.frombuffer(data, "<f8", size, at + 20), seen)
            out.rounds[level] = rounds
            at += 20 + 8 * size
        return out


class TDigest:
    """Clusters of values, smaller towards both ends; ranks and quantiles by interpolation.

    Sorted values are cut where an arcsine of the rank passes a whole number: the scale has k
    of those, close together at both ends.
    """

    _HEAD = struct.Struct("<BBBHBxx")

    def __init__(self, k: int = 200):
        if k < 10:
            raise ValueError("k is 10 at least")
        self.k = k
        self.means, self.weights = np.zeros(0), np.zeros(0, np.int64)
        self.low, self.high = math.inf, -math.inf

    @property
    def n(self) -> int:
        return int(self.weights.sum())

    def extend(self, values) -> TDigest:
        v = np.asarray(values, np.float64)
        v = v[np.isfinite(v)]
        if len(v):
            self._add(v, np.ones(len(v), np.int64), float(v.min()), float(v.max()))
        return self

    def merge(self, other: TDigest) -> TDigest:
        if len(other.means):
            self._add(other.means, other.weights, other.low, other.high)
        return self

    def _add(self, means, weights, low: float, high: float) -> None:
        self.low, self.high = min(self.low, low), max(self.high, high)
        m, w = np.concatenate([self.means, means]), np.concatenate([self.weights, weights])
        order = np.argsort(m, kind="stable")
        m, w = m[order], w[order]
        middle = (np.cumsum(w) - w / 2) / w.sum()
        cell = np.floor(self.k / np.pi * np.arcsin(2 * middle - 1)).astype(np.int64)
        # the least and the greatest value are clusters of their own
        cell[0] -= 1
        cell[-1] += 1
        at = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1])
        total = np.add.reduceat(w, at)
        # a mean over differences from the cluster's first value, which is exact where all are equal
        first = np.repeat(m[at], np.diff(at, append=len(m)))
        self.means, self.weights = m[at] + np.add.reduceat((m - first) * w, at) / total, total

    def _knots(self) -> tuple[np.ndarray, np.ndarray]:
        """(value, weight below) points of a line; single values are flat for half a weight on each side."""
        w = self.weights
        middle = np.cumsum(w) - w / 2
        one = w == 1
        x = np.concatenate([self.means, self.means[one], self.means[one], [self.low, self.high]])
        y = np.concatenate([middle, middle[one] - 0.5, middle[one] + 0.5, [0.0, float(w.sum())]])
        if not one[0]:
            x, y = np.append(x, self.low), np.append(y, 0.5)
        if not one[-1]:
            x, y = np.append(x, self.high), np.append(y, w.sum() - 0.5)
        order = np.lexsort((x, y))
        return x[order], y[order]

    def quantile(self, rank: float) -> float:
        if not 0.0 <= rank <= 1.0:
            raise ValueError("a rank lies between 0 and 1")
        if not len(self.means):
            raise ValueError("nothing was seen")
        x, y = self._knots()
        return float(min(max(np.interp(rank * y[-1], y, np.maximum.accumulate(x)), self.low), self.high))

    def rank(self, value: float) -> float:
        """Weight below the value, and half of what equals it."""
        if value != value:
            raise ValueError("NaN has no rank")
        if value < self.low or value > self.high:
            return float(value > self.high)
        x, y = self._knots()
        x = np.maximum.accumulate(x)
        a, b = np.searchsorted(x, value, "left"), np.searchsorted(x, value, "right")
        got = (y[a] + y[b - 1]) / 2 if b > a else np.interp(value, x[[a - 1, a]], y[[a - 1, a]])
        return float(got / y[-1])

    def cdf(self, splits) -> list[float]:
        if any(not a < b for a, b in zip(splits, splits[1:], strict=False)):
            raise ValueError("split points must increase")
        return [*(self.rank(s) for s in splits), 1.0]

    def pmf(self, splits) -> list[float]:
        c = self.cdf(splits)
        return [c[0], *(b - a for a, b in zip(c, c[1:], strict=False))]

    def to_bytes(self) -> bytes:
        """Preamble longs 2, version 1, family 20, k, flags; counts, ends, (mean, weight) pairs."""
        if not len(self.means):
            return self._HEAD.pack(1, 1, 20, self.k, 1)
        body = np.empty(len(self.means), [("m", "<f8"), ("w", "<u8")])
        body["m"], body["w"] = self.means, self.weights
        return self._HEAD.pack(2, 1, 20, self.k, 0) + struct.pack("<IIdd", len(self.means), 0, self.low, self.high) + body.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> TDigest:
        _, version, family, k, flags = cls._HEAD.unpack_from(data)
        if (version, family) != (1, 20):
            raise ValueError("not a t-digest")
        out = cls(k)
        if flags & 1:
            return out
        if flags & 2:  # a single value
            out.extend(np.frombuffer(data, "<f8", 1, 8))
            return out
        n, loose, out.low, out.high = struct.unpack_from("<IIdd", data, 8)
        body = np.frombuffer(data, [("m", "<f8"), ("w", "<u8")], n, 32)
        out.means, out.weights = body["m"].copy(), body["w"].astype(np.int64)
        return out.extend(np.frombuffer(data, "<f8", loose, 32 + 16 * n))
