"""Quantiles and tail probabilities without a statistics library; used on the driver on a handful of numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile of Student's t for p > 0.5, by bisection."""
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def t_table(p: float = 0.975, most: int = 200) -> list[tuple[int, float]]:
    """(degrees of freedom, quantile) from 1 to ``most``."""
    return [(df, t_quantile(p, df)) for df in range(1, most + 1)]


def spearman_p(r: float, n: int) -> float:
    """Two-sided p-value of a rank correlation, by the t approximation."""
    if n < 3 or abs(r) >= 1:
        return math.nan if n < 3 else 0.0
    return t_two_sided(r * math.sqrt((n - 2) / ((1 + r) * (1 - r))), n - 2)
