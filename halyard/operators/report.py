"""Tables of results: summaries, a long index of numbers, and comparison of two tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions.vectors import finite
from halyard.operators.corpus import with_ordinal


def series_summary(df: DataFrame, keys: list[str], x: str = "year", n: str = "n") -> DataFrame:
    """(keys, n_bins, total, least, middle, most, first_x, last_x, first_n, last_n) of annual counts."""
    return df.groupBy(*keys).agg(
        F.count("*").cast("long").alias("n_bins"),
        F.sum(n).cast("long").alias("total"),
        F.min(n).alias("least"),
        F.median(n).alias("middle"),
        F.max(n).alias("most"),
        F.min(x).alias("first_x"),
        F.max(x).alias("last_x"),
        F.min_by(n, x).alias("first_n"),
        F.max_by(n, x).alias("last_n"),
    )


def numeric_index(tables: dict[str, tuple[DataFrame, list[str]]], skip: frozenset[str] = frozenset()) -> DataFrame:
    """(case, metric, value, source) of all numeric cells; a value that is not finite is an error.

    ``tables`` maps a name to a table and its key columns; the first key is
    the case, the others go before the metric's name.
    """
    out = None
    for name, (df, keys) in tables.items():
        numbers = [c for c, t in df.dtypes if c not in keys and c not in skip and t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
        long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(keys, numbers, "metric", "value")
        path = [F.col(k).cast("string") for k in keys[1:]]
        part = long.select(
            F.col(keys[0]).cast("string").alias("case"),
            F.concat_ws(".", F.lit(name), *path, "metric").alias("metric"),
            finite(F.col("value"), name).alias("value"),
            F.concat(F.lit(name + ":"), "metric").alias("source"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def row_diff(old: DataFrame, new: DataFrame, key: str, vector: str) -> DataFrame:
    """One row: keys in both, on one side only, and the largest difference of their vectors' elements."""
    both = old.select(key, F.col(vector).alias("_a")).join(new.select(key, F.col(vector).alias("_b")), key, "full_outer")
    at = F.zip_with(F.col("_a").cast("array<double>"), F.col("_b").cast("array<double>"), lambda a, b: F.abs(a - b))
    return both.agg(
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("long").alias("matched"),
        F.count_if(F.col("_b").isNull()).cast("long").alias("old_only"),
        F.count_if(F.col("_a").isNull()).cast("long").alias("new_only"),
        F.max(F.array_max(at)).alias("max_abs_diff"),
    )


def p_tolerance(p: float, atol: float) -> float:
    """A column of p-values is held to half a percent of the value, but never beyond ``atol``."""
    return min(atol, max(1e-12, 0.005 * abs(p)))


def differences(a: DataFrame, b: DataFrame, atol: float = 0.0, ids: frozenset[str] = frozenset(), p_columns: frozenset[str] = frozenset()) -> list[str]:
    """What keeps small result table ``a`` from matching ``b``: columns, rows in order, ids exactly, numbers within ``atol``.

    Numbers that are not finite differ even if both are alike.  Result tables
    are read to the driver; they have a row for each bin or case.
    """
    if a.columns != b.columns:
        return [f"columns {a.columns} and {b.columns}"]
    left, right = a.collect(), b.collect()
    if len(left) != len(right):
        return [f"{len(left)} and {len(right)} rows"]
    found = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        for c in a.columns:
            u, v = x[c], y[c]
            number = c not in ids and all(isinstance(w, int | float) and not isinstance(w, bool) for w in (u, v))
            if not number:
                same = u == v
            elif not (math.isfinite(u) and math.isfinite(v)):
                same = False
            else:
                same = abs(u - v) <= (p_tolerance(v, atol) if c in p_columns else atol)
            if not same:
                found.append(f"row {i}, {c}: {u!r} and {v!r}")
    return found


def ordered_zip(left: DataFrame, left_order: list[str], right: DataFrame, right_order: list[str], same: list[str] | None = None) -> DataFrame:
    """(ordinal, left's columns, right's columns): rows at the same place in two total orders, from 0.

    ``same`` names columns of both that must agree at each place; they stand
    once in the result, and a place where they differ is an error.
    """
    same = same or []
    a = with_ordinal(left, *left_order)
    b = with_ordinal(right.withColumnsRenamed({c: f"_r_{c}" for c in same}), *[f"_r_{c}" if c in same else c for c in right_order])
    both = a.join(b, "ordinal")
    for c in same:
        at = F.concat(F.lit(f"{c} differs at "), F.col("ordinal").cast("string"))
        both = both.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(at).cast(left.schema[c].dataType)))
    return both.drop(*[f"_r_{c}" for c in same])


def score_audit(scores: DataFrame, records: DataFrame, key: str, columns: list[str], slack: float = 1e-5) -> DataFrame:
    """One row: scores, records that have one, scores without a record, out of range, and of another text than the record's (by sha256)."""
    wide = F.greatest(F.lit(0.0), *[F.coalesce(F.abs(c), F.lit(9.0)) for c in columns]) > 1 + slack
    own = records.select(key, F.lit(True).alias("_there"), F.sha2("text", 256).alias("_own"))
    met = scores.join(own, key, "left")
    return met.agg(
        F.count("*").alias("members"),
        F.count_distinct(key).alias("records"),
        F.count_if(F.col("_there").isNull()).alias("without_record"),
        F.count_if(wide).cast("long").alias("out_of_range"),
        F.count_if(~F.col("text_sha256").eqNullSafe(F.col("_own")) | F.col("_own").isNull()).cast("long").alias("other_text"),
    )


def check_same(given: dict, wanted: dict, what: str = "configuration") -> None:
    """An error that names every entry in which two configurations differ; lists count as sets."""
    plain = lambda v: sorted(map(str, v)) if isinstance(v, list | tuple | set | frozenset) else v
    off = sorted(k for k in given.keys() | wanted.keys() if plain(given.get(k)) != plain(wanted.get(k)))
    if off:
        raise ValueError(f"{what} differs: {', '.join(f'{k} is {given.get(k)!r}, not {wanted.get(k)!r}' for k in off)}")


def check_outputs(made: dict[str, DataFrame], wanted: dict[str, DataFrame], atol: float = 0.0) -> None:
    """An error unless every wanted result table is made, no other is, and each matches (see differences)."""
    if made.keys() != wanted.keys():
        raise ValueError(f"missing {sorted(wanted.keys() - made.keys())}, unexpected {sorted(made.keys() - wanted.keys())}")
    off = {name: found for name in wanted if (found := differences(made[name], wanted[name], atol))}
    if off:
        raise ValueError(f"results differ: {off}")
