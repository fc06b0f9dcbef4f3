"""Order statistics of all prefixes of a sequence at once, in numpy.

The sequence's ranks are split bit by bit, the highest first; each level knows how many
zeros lead up to every place. So the k-th least of any prefix, or how many of a prefix
lie below a rank, takes one look a bit, for all prefixes together.
"""

from __future__ import annotations

import numpy as np


class PrefixOrder:
    """Ranks ``0 .. size - 1`` in sequence; ties are allowed."""

    def __init__(self, ranks: np.ndarray, size: int) -> None:
        self.bits, self.length = max(1, int(size).bit_length()), len(ranks)
        self.zeros: list[np.ndarray] = []
        now = np.asarray(ranks, np.int64)
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit) & 1
            before = np.zeros(len(now) + 1, np.int64)
            np.cumsum(1 - one, out=before[1:])
            self.zeros.append(before)
            now = np.concatenate([now[one == 0], now[one == 1]])

    def below(self, prefix: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of the first ``prefix`` elements have a rank below ``rank`` (``size`` at most)."""
        end = np.asarray(prefix, np.int64)
        rank = np.asarray(rank, np.int64)
        end, rank = np.broadcast_arrays(end, rank)
        start, found = np.zeros(end.shape, np.int64), np.zeros(end.shape, np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            before = self.zeros[level]
            a, b, up = before[start], before[end], (rank >> bit) & 1 == 1
            found += np.where(up, b - a, 0)
            start, end = np.where(up, before[-1] + start - a, a), np.where(up, before[-1] + end - b, b)
        return found

    def kth(self, prefix: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The rank of the k-th least (from 0) of the first ``prefix`` elements; there must be that many."""
        end, k = (x.copy() for x in np.broadcast_arrays(np.asarray(prefix, np.int64), np.asarray(k, np.int64)))
        start, out = np.zeros(end.shape, np.int64), np.zeros(end.shape, np.int64)
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            before = self.zeros[level]
            a, b = before[start], before[end]
            up = k >= b - a
            k = np.where(up, k - (b - a), k)
            out += np.where(up, 1 << bit, 0)
            start, end = np.where(up, before[-1] + start - a, a), np.where(up, before[-1] + end - b, b)
        return out


class Prefixes:
    """Values in sequence, none of them missing."""

    def __init__(self, values: np.ndarray) -> None:
        order = np.argsort(values, kind="stable")
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.sorted, self.order = values[order], PrefixOrder(ranks, max(len(values), 1))

    def value(self, prefix: np.ndarray, k: np.ndarray) -> np.ndarray:
        return self.sorted[self.order.kth(prefix, k)]

    def deviations(self, prefix: np.ndarray, middle: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th least (from 0) of the deviations of the first ``prefix`` values from ``middle``, and the
        next one after it (the same if there is none).

        Those at or below the middle, from high to low, and those above it are two ascending
        sequences of deviations; bisection finds how many of the least come from the first.
        """
        cut = self.order.below(prefix, np.searchsorted(self.sorted, middle, "right"))
        low, high = np.maximum(0, k + 1 - (prefix - cut)), np.minimum(cut, k + 1)

        def left(i: np.ndarray) -> np.ndarray:
            ok = (i >= 0) & (i < cut)
            return np.where(ok, middle - self.value(np.maximum(prefix, 1), np.where(ok, cut - 1 - i, 0)), np.inf)

        def right(j: np.ndarray) -> np.ndarray:
            ok = (j >= 0) & (j < prefix - cut)
            return np.where(ok, self.value(np.maximum(prefix, 1), np.where(ok, cut + j, 0)) - middle, np.inf)

        while (low < high).any():
            i = (low + high) // 2
            j = k + 1 - i
            more = (low < high) & (j > 0) & (i < cut) & (right(j - 1) > left(i))
            low, high = np.where(more, i + 1, low), np.where(more, high, np.where(low < high, i, high))
        i, j = low, k + 1 - low
        last = np.maximum(np.where(i > 0, left(i - 1), 0.0), np.where(j > 0, right(j - 1), 0.0))
        after = np.minimum(left(i), right(j))
        return last, np.where(np.isfinite(after), after, last)


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of the first 0, 1, .. n values; NaN values don't count; 0 of none, and MAD 0 of one."""
    ok = ~np.isnan(values)
    at = np.concatenate([[0], np.cumsum(ok)])
    own = Prefixes(values[ok])
    n = np.arange(1, at[-1] + 1)
    medians, mads = np.zeros(at[-1] + 1), np.zeros(at[-1] + 1)
    if len(n):
        low, odd = own.value(n, (n - 1) // 2), n % 2 == 1
        medians[1:] = np.where(odd, low, (low + own.value(n, n // 2)) / 2)
        one, two = own.deviations(n, medians[1:], (n - 1) // 2)
        mads[1:] = np.where(n < 2, 0.0, np.where(odd, one, (one + two) / 2))
    return medians[at], mads[at]
