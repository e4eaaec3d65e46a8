"""Exact p-values: Kendall's tau without ties, and Student's t for whole degrees of freedom."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache(maxsize=256)
def inversion_counts(n: int) -> tuple[int, ...]:
    """How many orders of n things have 0, 1, 2, ... inversions."""
    counts = [1]
    for size in range(2, n + 1):
        longer = [0] * (len(counts) + size - 1)
        running = 0
        for k in range(len(longer)):
            running += counts[k] if k < len(counts) else 0
            running -= counts[k - size] if k >= size and k - size < len(counts) else 0
            longer[k] = running
        counts = longer
    return tuple(counts)


def kendall_p(n: int, discordant: int) -> float:
    """Two-sided, from the exact null distribution of untied orders."""
    whole = n * (n - 1) // 2
    few = min(discordant, whole - discordant)
    if 2 * few == whole:
        return 1.0
    return min(1.0, 2 * sum(inversion_counts(n)[: few + 1]) / math.factorial(n))


def kendall_p_tied(s: float, n: int, ties_x: list[int], ties_y: list[int]) -> float:
    """Two-sided, from the normal approximation with tie-corrected variance."""
    v0 = n * (n - 1) * (2 * n + 5)
    of = lambda t: sum(k * (k - 1) * (2 * k + 5) for k in t)
    pairs = lambda t: sum(k * (k - 1) for k in t)
    triples = lambda t: sum(k * (k - 1) * (k - 2) for k in t)
    variance = (v0 - of(ties_x) - of(ties_y)) / 18 + pairs(ties_x) * pairs(ties_y) / (2 * n * (n - 1))
    if n > 2:
        variance += triples(ties_x) * triples(ties_y) / (9 * n * (n - 1) * (n - 2))
    return math.erfc(abs(s) / math.sqrt(variance) / math.sqrt(2)) if variance > 0 else math.nan


def t_p(t: float, dof: int) -> float:
    """Two-sided p of Student's t by the finite trigonometric series."""
    if dof < 1 or math.isnan(t):
        return math.nan
    theta = math.atan2(abs(t), math.sqrt(dof))
    sin, cos = math.sin(theta), math.cos(theta)
    if dof % 2:
        total, term = 0.0, cos
        for k in range(1, (dof - 1) // 2 + 1):
            total += term
            term *= cos * cos * 2 * k / (2 * k + 1)
        inside = 2 / math.pi * (theta + sin * total)
    else:
        total, term = 0.0, 1.0
        for k in range(dof // 2):
            total += term
            term *= cos * cos * (2 * k + 1) / (2 * k + 2)
        inside = sin * total
    return max(0.0, 1 - inside)


@F.pandas_udf(T.DoubleType())
def _kendall(xs: pd.Series, ys: pd.Series) -> pd.Series:
    return pd.Series([series_p(list(x), list(y)) for x, y in zip(xs, ys, strict=True)])


def series_p(x: list[float], y: list[float]) -> float:
    """p of a series: exact without ties up to 33 points or one discordant pair, else the normal approximation."""
    n = len(x)
    if n < 2:
        return math.nan
    sign = lambda d: int(d > 0) - int(d < 0)
    s = sum(sign(x[j] - x[i]) * sign(y[j] - y[i]) for i in range(n) for j in range(i + 1, n))
    ties = [[v.count(k) for k in set(v)] for v in (x, y)]
    whole = n * (n - 1) // 2
    if all(k == 1 for t in ties for k in t):
        discordant = (whole - s) // 2
        if n <= 33 or min(discordant, whole - discordant) <= 1:
            return kendall_p(n, discordant)
    return kendall_p_tied(s, n, *ties)


def kendall_pvalue(points: Column) -> Column:
    """Of a series as functions.series makes it."""
    return _kendall(F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"]))


@F.pandas_udf(T.DoubleType())
def _t(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([math.nan if pd.isna(a) or pd.isna(b) else t_p(float(a), int(b)) for a, b in zip(t, dof, strict=True)])


def t_pvalue(t: Column, dof: Column) -> Column:
    return _t(t.cast("double"), dof.cast("long"))
