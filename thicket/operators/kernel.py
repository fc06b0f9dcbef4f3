"""Running medians and median absolute deviations over a sample that grows one by one.

The one thing that window functions can only do in quadratic time. Values are kept in
order; the deviations on both sides of the median are two ascending sequences, and the
middle one of both is found by bisection.
"""

from __future__ import annotations

from bisect import insort

import numpy as np


def middle(x: list[float]) -> float:
    n = len(x)
    return 0.0 if not n else x[n // 2] if n % 2 else (x[n // 2 - 1] + x[n // 2]) / 2


def kth_deviation(x: list[float], m: float, cut: int, k: int) -> float:
    """The k-th least (from 0) of |x - m|; x[:cut] lies at or below m, the rest above."""
    low, high = max(0, k + 1 - (len(x) - cut)), min(cut, k + 1)
    while low < high:  # how many of the k + 1 least come from the left
        i = (low + high) // 2
        j = k + 1 - i
        if j > 0 and i < cut and x[cut + j - 1] - m > m - x[cut - 1 - i]:
            low = i + 1
        else:
            high = i
    i, j = low, k + 1 - low
    return max(m - x[cut - i] if i else 0.0, x[cut + j - 1] - m if j else 0.0)


def deviation(x: list[float], m: float) -> float:
    """Median absolute deviation of ascending values; 0 of fewer than two."""
    n = len(x)
    if n < 2:
        return 0.0
    cut = n // 2 + (n % 2)
    # Values equal to the median may stand on either side: their deviation is 0.
    while cut < n and x[cut] <= m:
        cut += 1
    if n % 2:
        return kth_deviation(x, m, cut, n // 2)
    return (kth_deviation(x, m, cut, n // 2 - 1) + kth_deviation(x, m, cut, n // 2)) / 2


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median and MAD of the first 0, 1, .. n values; NaN values don't count."""
    have: list[float] = []
    medians, mads = np.zeros(len(values) + 1), np.zeros(len(values) + 1)
    for i, v in enumerate(values.tolist()):
        if v == v:
            insort(have, v)
            medians[i + 1] = middle(have)
            mads[i + 1] = deviation(have, medians[i + 1])
        else:
            medians[i + 1], mads[i + 1] = medians[i], mads[i]
    return medians, mads


def running_variance(values: np.ndarray) -> np.ndarray:
    """Population variance of the first 0, 1, .. n values; NaN values don't count; 0 of none."""
    ok = ~np.isnan(values)
    v = np.where(ok, values, 0.0)
    v = np.where(ok, v - (v[ok].mean() if ok.any() else 0.0), 0.0)
    n = np.concatenate([[0], np.cumsum(ok)])
    s, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (v, v * v))
    return np.maximum(np.divide(q, n, out=np.zeros(len(n)), where=n > 0) - np.divide(s, n, out=np.zeros(len(n)), where=n > 0) ** 2, 0.0)


def two_sided(values: np.ndarray, mode: str) -> tuple[np.ndarray, np.ndarray]:
    """Dispersion before each cut k = 0 .. n and from it on."""
    if mode == "variance":
        return running_variance(values), running_variance(values[::-1])[::-1]
    return running(values)[1], running(values[::-1])[1][::-1]


def cut_scores(outputs: np.ndarray, weights: np.ndarray, mode: str, norm: str) -> np.ndarray:
    """Weighted dispersion of each cut over output columns; infinite where it isn't a number."""
    size = len(outputs) + 1
    k = np.arange(size)
    total = np.zeros(size)
    for j in np.flatnonzero(weights):
        left, right = two_sided(outputs[:, j], mode)
        d = right * ((size - k) / size) + left * ((k + 1) / size)
        total += weights[j] * (d if norm == "l1" else d * d)
    total = total / weights.sum() if weights.sum() else np.full(size, np.inf)
    return np.where(np.isfinite(total) & ((total == 0) | (np.abs(total) >= 2.2250738585072014e-308)), total, np.inf)


def best_cut(scores: np.ndarray) -> int | None:
    """The least score of cuts 3 .. n - 3; of equal ones the last."""
    n = len(scores) - 1
    if n < 6:
        return None
    inner = scores[3 : n - 2]
    return 3 + len(inner) - 1 - int(np.argmin(inner[::-1]))
