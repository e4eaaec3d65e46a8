"""Column functions over vectors stored as arrays; all sums are in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda p, q: p * q))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(v), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length; never a division by zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def scale(v: Column, by: Column) -> Column:
    return F.transform(doubles(v), lambda x: x / by)


def unit_shifted(v: Column) -> Column:
    """v / (|v| + 1e-9)."""
    return scale(v, norm(v) + EPSILON)


def unit_clipped(v: Column) -> Column:
    """v / max(|v|, 1e-9)."""
    return scale(v, F.greatest(norm(v), F.lit(EPSILON)))


def unit(v: Column) -> Column:
    """v / |v|; a vector that has no finite, positive length is an error."""
    length = norm(v)
    bad = F.isnan(length) | (length == 0) | (length == float("inf")) | length.isNull()
    return scale(v, F.when(bad, F.raise_error(F.lit("vector without a finite positive length")).cast("double")).otherwise(length))


def finite(x: Column, what: str) -> Column:
    """x, or an error where it is null, NaN or infinite: such values are never dropped."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"{what} is not finite")).cast("double")).otherwise(x)
