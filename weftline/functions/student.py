"""Student's t distribution, by the continued fraction of the incomplete beta function."""

from __future__ import annotations

import math


def _fraction(a: float, b: float, x: float) -> float:
    """Lentz's evaluation of the continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _fraction(a, b, x) / a
    return 1 - front * _fraction(b, a, 1 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    """The probability of a value at least so far from 0."""
    if math.isnan(t):
        return math.nan
    return 0.0 if math.isinf(t) else incomplete_beta(freedom / 2, 0.5, freedom / (freedom + t * t))


def t_cdf(t: float, freedom: float) -> float:
    tail = t_two_sided(t, freedom) / 2
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, freedom: float) -> float:
    """The value below which a share p lies, by bisection."""
    if p == 0.5:
        return 0.0
    low, high = -1.0, 1.0
    while t_cdf(low, freedom) > p:
        low *= 2
    while t_cdf(high, freedom) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, freedom) < p else (low, middle)
    return (low + high) / 2
