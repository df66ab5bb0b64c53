"""Tail probabilities for result rows: normal, chi-square and F, and exact ones of ranks in small samples."""

from __future__ import annotations

import math
from functools import cache, lru_cache

import numpy as np


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function: a series below ``a + 1``, a continued fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - front * total)
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d, c = 1 / (step * d + b), b + step / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def chi2_tail(x: float, df: float) -> float:
    return _gamma_upper(df / 2, x / 2)


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    h = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + step * d or tiny), 1 + step / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_tail(f: float, df1: float, df2: float) -> float:
    return _beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_two_sided(t: float, df: float) -> float:
    return f_tail(t * t, 1, df)


@cache
def signed_rank_counts(n: int) -> tuple[int, ...]:
    """How many of the 2ⁿ signings of the ranks 1 to n have each sum of positive ranks."""
    counts = [1]
    for rank in range(1, n + 1):
        counts = [(counts[w] if w < len(counts) else 0) + (counts[w - rank] if w >= rank else 0) for w in range(len(counts) + rank)]
    return tuple(counts)


def signed_rank_exact(n: float, w: float) -> float:
    """Two-sided p of a sum of positive ranks; between two sums the lower one counts."""
    counts, w = signed_rank_counts(int(n)), int(w)
    if w == (len(counts) - 1) // 2:
        return 1.0
    return min(1.0, 2 * min(sum(counts[: w + 1]), sum(counts[w:])) / 2 ** int(n))


@lru_cache(maxsize=64)
def rank_sum_shares(n1: int, n2: int) -> np.ndarray:
    """Of all ways to deal n1 + n2 ranks to two samples, the share with each U, up to the middle.

    The number of ways is the coefficient of a Gaussian binomial: n1 times, a window
    of differences and a sum by steps. Up to the middle the coefficients rise, so
    nothing of size is lost in the differences.
    """
    n1, n2 = sorted((n1, n2))
    half = n1 * n2 // 2 + 1
    counts = np.zeros(half)
    counts[0] = 1.0
    for i in range(1, n1 + 1):
        if n2 + i < half:
            counts[n2 + i :] -= counts[: half - n2 - i].copy()
        padded = np.zeros(-(-half // i) * i)
        padded[:half] = counts
        # One more sample: divided by the number of deals so far, so that they stay shares.
        counts = np.cumsum(padded.reshape(-1, i), axis=0).ravel()[:half] * (i / (n2 + i))
    return counts


def rank_sum_exact(n1: float, n2: float, u: float) -> float:
    """Two-sided p of Mann and Whitney's U without ties."""
    n1, n2 = int(n1), int(n2)
    shares, least = rank_sum_shares(n1, n2), int(min(u, n1 * n2 - u))
    return min(1.0, 2 * float(shares[: least + 1].sum()))
