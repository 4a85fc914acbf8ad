"""Special functions for where Spark has none: plain Python, and as vectorised UDFs."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


def normal_quantile(p: float) -> float:
    """Phi^-1(p); infinite at 0 and 1."""
    if p <= 0 or p >= 1:
        return math.inf if p >= 1 else -math.inf
    return _NORMAL.inv_cdf(p)


def normal_survival(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def binomial_pmf(n: int, p: float) -> list[float]:
    """P(k of n) for k = 0 … n by recurrence from the likelier end."""
    if p <= 0 or p >= 1:
        return [float(k == (n if p >= 1 else 0)) for k in range(n + 1)]
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(n + 1)]
    return [math.exp(x) for x in logs]


def beta_survival(x: float, a: float, b: float) -> float:
    """P(X > x) for X ~ Beta(a, b), by the continued fraction of the incomplete beta."""
    if x <= 0:
        return 1.0
    if x >= 1:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return 1.0 - front * _fraction(x, a, b) / a
    return front * _fraction(1 - x, b, a) / b


def beta_mean_difference(a: float, b: float, steps: int = 2000) -> float:
    """E|X - Y| for independent X, Y ~ Beta(a, b): twice the integral of F (1 - F)."""
    total = 0.0
    for i in range(steps):
        s = beta_survival((i + 0.5) / steps, a, b)
        total += s * (1 - s)
    return 2 * total / steps


def _fraction(x: float, a: float, b: float, tiny: float = 1e-300) -> float:
    """Lentz's evaluation."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d, c = 1.0 + term * d, 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            step = d * c
            h *= step
        if abs(step - 1.0) < 1e-14:
            break
    return h


@F.pandas_udf(DoubleType())
def normal_quantile_udf(p: pd.Series) -> pd.Series:
    return p.map(normal_quantile)


@F.pandas_udf(DoubleType())
def normal_survival_udf(z: pd.Series) -> pd.Series:
    return z.map(normal_survival)


@F.pandas_udf(DoubleType())
def beta_survival_udf(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([beta_survival(*row) for row in zip(x, a, b, strict=True)], dtype=float)


def uniform(*keys: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the keys and the seed alone, not on how the
    rows are partitioned."""
    bits = F.shiftrightunsigned(F.xxhash64(*keys, F.lit(seed)), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


@F.pandas_udf(DoubleType())
def beta_mean_difference_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([beta_mean_difference(*row) for row in zip(a, b, strict=True)], dtype=float)
