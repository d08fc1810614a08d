"""Distribution functions from their public definitions (no SciPy needed)."""

from __future__ import annotations

import functools
import math


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, continued fraction by Lentz's method."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(1 - x, b, a)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    c, d = 1.0, 1.0 / (1 - (a + b) * x / (a + 1) or 1e-300)
    f = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for t in (even, odd):
            d = 1.0 / (1 + t * d or 1e-300)
            c = 1 + t / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return math.exp(log_front) * f / a


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t."""
    return incomplete_beta(df / (df + t * t), df / 2, 0.5)


@functools.lru_cache(maxsize=4096)
def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    if p < 0.5:
        return -t_quantile(1 - p, df)
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_two_sided(mid, df) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


@functools.lru_cache(maxsize=256)
def _u_counts(n: int, m: int) -> tuple[int, ...]:
    """Number of orderings with each value of U: coefficients of the Gaussian binomial."""
    poly = [1]
    for i in range(1, m + 1):
        grown = [0] * (len(poly) + n + i)  # times (1 - q^(n+i))
        for k, v in enumerate(poly):
            grown[k] += v
            grown[k + n + i] -= v
        for k in range(i, len(grown)):  # divided by (1 - q^i)
            grown[k] += grown[k - i]
        poly = grown[: n * i + 1]
    return tuple(poly)


def mann_whitney_p(u: float, n: int, m: int, tie_term: float = 0.0) -> float:
    """Two-sided p of U: exact without ties if the smaller group has at most 8, else
    normal with tie correction (``tie_term`` = sum of t^3 - t) and continuity correction."""
    high = max(u, n * m - u)
    if tie_term == 0 and min(n, m) <= 8:
        counts = _u_counts(n, m)
        tail = sum(counts[math.ceil(high) :])
        return min(1.0, 2 * tail / math.comb(n + m, n))
    total = n + m
    variance = n * m / 12 * (total + 1 - tie_term / (total * (total - 1)))
    if variance <= 0:
        return 1.0
    return min(1.0, normal_two_sided(max(0.0, high - n * m / 2 - 0.5) / math.sqrt(variance)))
