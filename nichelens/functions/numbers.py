"""Numeric functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nichelens.functions.constants import PRICE_HIGH, PRICE_LOW


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within the bounds; NaN becomes the lower one."""
    return F.when(F.isnan(x), F.lit(low)).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(default))


def growth_ratio(recent: Column, base: Column) -> Column:
    return clamp((recent - base) / F.greatest(base, F.lit(1.0)), -1.0, 9.0)


def log_compress(v: Column, scale: float) -> Column:
    return F.when(v <= 0, F.lit(0.0)).otherwise(clamp(F.log1p(v) / F.log1p(F.lit(2.0 * scale)), 0.0, 1.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def price_score(mid: Column) -> Column:
    """0 at the lower anchor, 100 at the upper, in between by the logarithm."""
    return clamp(F.lit(100.0) * F.ln(mid / PRICE_LOW) / F.ln(F.lit(PRICE_HIGH / PRICE_LOW)), 0.0, 100.0)


def backoff(base: float, factor: float, cap: float, attempt: Column) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), attempt - 1), F.lit(cap))


def ewma(series: Column, alpha: float) -> Column:
    """Last value of the exponential average seeded with the first value; an empty series gives NULL."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be in (0, 1]")
    rest = F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0)))
    return F.when(F.size(series) > 0, F.aggregate(rest, F.get(series, 0), lambda level, v: F.lit(alpha) * v + F.lit(1 - alpha) * level))


def ewma_series(series: Column, alpha: float) -> Column:
    first = F.slice(series, 1, 1)
    rest = F.slice(series, 2, F.greatest(F.size(series) - 1, F.lit(0)))
    return F.when(F.size(series) > 0, F.aggregate(rest, first, lambda out, v: F.array_append(out, F.lit(alpha) * v + F.lit(1 - alpha) * F.element_at(out, -1)))).otherwise(first)


def mean_of(series: Column) -> Column:
    return F.when(F.size(series) > 0, F.aggregate(series, F.lit(0.0), lambda a, v: a + v) / F.size(series)).otherwise(F.lit(0.0))


def normalized_slope(series: Column) -> Column:
    """Least-squares slope over the index divided by |mean|; 0 for fewer than two values or mean 0."""
    n = F.size(series).cast("double")
    mean = mean_of(series)
    mid = (n - 1) / 2
    xy = F.aggregate(F.transform(series, lambda v, i: (i - mid) * (v - mean)), F.lit(0.0), lambda a, v: a + v)
    xx = n * (n * n - 1) / 12
    return F.when((n < 2) | (mean == 0), F.lit(0.0)).otherwise(xy / xx / F.abs(mean))
