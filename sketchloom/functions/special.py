"""Special functions in plain numpy and the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np


def digamma(x) -> np.ndarray:
    """Derivative of log gamma for positive arguments: recurrence up to 10, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(10):
        small = x < 10
        if not small.any():
            break
        out = np.where(small, out - 1 / np.where(small, x, 1), out)
        x = np.where(small, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h / a


def student_cdf(t: float, df: float) -> float:
    tail = 0.5 * incomplete_beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def student_quantile(p: float, df: float) -> float:
    """By bisection of the distribution function."""
    low, high = -1.0, 1.0
    while student_cdf(low, df) > p:
        low *= 2
    while student_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if student_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def log_big(n: int) -> float:
    """Natural logarithm of an integer of any size; -inf for 0."""
    if n <= 0:
        return -math.inf if n == 0 else math.nan
    shift = max(0, n.bit_length() - 1000)
    return math.log(n >> shift) + shift * math.log(2)
