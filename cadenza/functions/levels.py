"""Quantiles, interval levels and the names of forecast columns."""

from __future__ import annotations

import re
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

QUANTILES = tuple(k / 10 for k in range(1, 10))


def check_quantiles(quantiles: tuple[float, ...]) -> tuple[float, ...]:
    q = tuple(quantiles)
    if len(q) < 2:
        raise ValueError("at least two quantiles are needed")
    if any(not 0 < x < 1 for x in q):
        raise ValueError("quantiles lie between 0 and 1")
    if len(set(q)) < len(q):
        raise ValueError("quantiles must be unique")
    if list(q) != sorted(q):
        raise ValueError("quantiles must increase")
    return q


def levels_of(quantiles: tuple[float, ...] = QUANTILES) -> list[int]:
    """Interval levels between the i-th quantile from below and from above."""
    q, out = check_quantiles(quantiles), []
    for low, high in zip(q, reversed(q), strict=True):
        level = round(100 * (high - low))
        if level <= 0:
            break
        out.append(level)
    return out


def quantiles_of(level: float) -> tuple[float, float]:
    low = (1 - level / 100) / 2
    return low, 1 - low


def resolve(levels: list[int] | None, quantiles: tuple[float, ...] | None) -> tuple[float, ...]:
    """Quantiles asked for by either, not both; level 0 is the median."""
    if levels is not None and quantiles is not None:
        raise ValueError("give levels or quantiles, not both")
    if quantiles is not None:
        return check_quantiles(quantiles)
    return tuple(sorted({round(q, 10) for x in levels or [] for q in (quantiles_of(x) if x else (0.5,))}))


def column_name(model: str, q: float | None) -> str:
    """<model>, <model>-median, <model>-lo-L or <model>-hi-L."""
    if q is None:
        return model
    if abs(q - 0.5) < 1e-9:
        return f"{model}-median"
    return f"{model}-lo-{round(100 - 200 * q)}" if q < 0.5 else f"{model}-hi-{round(100 - 200 * (1 - q))}"


_FORECAST = re.compile(r"^(.+?)(?:-(?:lo|hi)-\d+(?:\.\d+)?|-median|-mean)$")


def model_names(columns: list[str], others: tuple[str, ...] = ()) -> list[str]:
    """Models that a wide table's columns belong to."""
    found = sorted({m[1] for c in columns if c not in others and (m := _FORECAST.match(c))})
    if not found:
        raise ValueError("no forecast columns")
    return found


def normal_quantile(mean: Column, sigma: Column, q: float) -> Column:
    return mean + F.lit(NormalDist().inv_cdf(q)) * sigma


def interpolate(sources: tuple[float, ...], values: list[Column], q: float) -> Column:
    """Linear in q between the neighbouring source quantiles, clamped at the ends."""
    pairs = sorted(zip(sources, values, strict=True), key=lambda x: x[0])
    if q <= pairs[0][0]:
        return pairs[0][1]
    for (a, x), (b, y) in zip(pairs, pairs[1:], strict=False):
        if abs(q - b) < 1e-12:
            return y
        if q < b:
            share = (q - a) / (b - a)
            return x * F.lit(1 - share) + y * F.lit(share)
    return pairs[-1][1]
