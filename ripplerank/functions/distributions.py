"""Tail areas and quantiles of the usual distributions, as numbers and as column functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / ((1 + up * d) or 1e-300), (1 + up / c) or 1e-300
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


def gamma_q(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function: series below a + 1, continued fraction beyond."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    out = d
    for i in range(1, 1000):
        up = -i * (i - a)
        b += 2
        d, c = 1 / ((up * d + b) or 1e-300), (b + up / c) or 1e-300
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out * scale


def t_sf(t: float, df: float) -> float:
    half = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def t_ppf(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_sf(mid, df) < p else (low, mid)
    return (low + high) / 2


def f_sf(f: float, d1: float, d2: float) -> float:
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_sf(x: float, df: float) -> float:
    return gamma_q(df / 2, x / 2)


def hypergeom_sf(k: int, population: int, good: int, draws: int) -> float:
    """P(more than k good ones among the draws)."""
    choose = lambda n, r: math.lgamma(n + 1) - math.lgamma(r + 1) - math.lgamma(n - r + 1)
    low, high = max(k + 1, draws - (population - good), 0), min(good, draws)
    return min(1.0, sum(math.exp(choose(good, i) + choose(population - good, draws - i) - choose(population, draws)) for i in range(low, high + 1)))


def column(fn: Callable[..., float]) -> Callable[..., F.Column]:
    """A function of numbers as a function of columns (Arrow batches); null or NaN in gives null."""

    @F.pandas_udf("double")
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else float(fn(*row)) for row in zip(*cols, strict=True)], dtype="float64")

    return run
