"""Statistics of a short series, held as a sorted array of (x, y) in one row.

A series has a point for each calendar bin, a few dozen at most, so all pairs
of its points stay inside one row: no self-join, no shuffle beyond the one that
gathered the series.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series(x: Column, y: Column) -> Column:
    """Aggregate: the points sorted by x."""
    return F.array_sort(F.collect_list(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))))


def pairs(points: Column) -> Column:
    """(dx, dy) of every two points, the later less the earlier."""
    return F.flatten(F.transform(points, lambda p, i: F.transform(F.slice(points, i + 2, F.size(points)), lambda q: F.struct((q["x"] - p["x"]).alias("dx"), (q["y"] - p["y"]).alias("dy")))))


def kendall(points: Column) -> Column:
    """Kendall's tau-b; null if either side is all ties."""
    zero = F.lit(0.0)
    start = F.struct(zero.alias("s"), zero.alias("nx"), zero.alias("ny"))

    def add(acc: Column, p: Column) -> Column:
        sx, sy = F.signum(p["dx"]), F.signum(p["dy"])
        return F.struct((acc["s"] + sx * sy).alias("s"), (acc["nx"] + F.abs(sx)).alias("nx"), (acc["ny"] + F.abs(sy)).alias("ny"))

    return F.aggregate(pairs(points), start, add, lambda acc: acc["s"] / F.nullif(F.sqrt(acc["nx"] * acc["ny"]), zero))


def own_order_tau(values: Column) -> Column:
    """Kendall's tau-b of an array of numbers against their places; null if all are equal."""

    def of(signs: Column) -> Column:
        add = lambda f: F.aggregate(signs, F.lit(0.0), lambda a, s: a + f(s))
        return add(lambda s: s) / F.nullif(F.sqrt(F.size(signs) * add(F.abs)), F.lit(0.0))

    signs = F.flatten(F.transform(values, lambda p, i: F.transform(F.slice(values, i + 2, F.size(values)), lambda q: F.signum(q - p))))
    return F.element_at(F.transform(F.array(signs), of), 1)


def median(values: Column) -> Column:
    """Of an array of doubles; null if it is empty."""
    ordered = F.array_sort(values)
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def theil_sen(points: Column) -> Column:
    """Median slope over pairs that differ in x."""
    rising = F.filter(pairs(points), lambda p: p["dx"] != 0)
    return median(F.transform(rising, lambda p: p["dy"] / p["dx"]))


def intercept(points: Column, slope: Column) -> Column:
    return median(F.transform(points, lambda p: p["y"])) - slope * median(F.transform(points, lambda p: p["x"]))


def partial_tau(xy: Column, xz: Column, yz: Column) -> Column:
    """Kendall's partial tau of x and y given z."""
    return (xy - xz * yz) / F.nullif(F.sqrt((1 - xz * xz) * (1 - yz * yz)), F.lit(0.0))


def direction(tau: Column, edge: float = 0.1, names: tuple[str, str, str] = ("div", "conv", "flat")) -> Column:
    return F.when(tau < -edge, names[0]).when(tau > edge, names[1]).otherwise(names[2])


def add_one_p(exceed: Column, replicates: Column) -> Column:
    return (exceed + 1) / (replicates + 1)


def significant(p: Column, level: float = 0.05) -> Column:
    return (p < level).cast("int")


def rounded(x: Column, places: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(x, places) + F.lit(0.0)


def fixed(x: Column, places: int) -> Column:
    """A number's text with so many places; it is rounded half away from zero first."""
    return F.format_string(f"%.{places}f", F.round(x, places))


def scientific(x: Column, places: int = 2) -> Column:
    """A number's text like 1.23e-05."""
    return F.format_string(f"%.{places}e", x)


def general(x: Column, digits: int = 6) -> Column:
    """A number's text with so many significant digits and no trailing zeros, scientific below 1e-4 and from 10**digits on."""
    parts = F.split(F.format_string(f"%.{digits - 1}e", x), "e")
    power = parts[1].cast("int")
    bare = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0+$", "")).otherwise(t)
    plain = F.lit(None).cast("string")
    for k in range(-4, digits):
        plain = F.coalesce(plain, F.when(power == k, bare(F.format_string(f"%.{digits - 1 - k}f", x))))
    written = F.concat(bare(parts[0]), F.lit("e"), parts[1])
    return F.when(x == 0, F.lit("0")).when((power < -4) | (power >= digits), written).otherwise(plain)
