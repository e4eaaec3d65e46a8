"""Column functions over record texts, years and types."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Types that are evidence of high grade, by substring.
HIGH_EVIDENCE = ("randomized controlled trial", "clinical trial", "comparative study", "multicenter study")


def strip(c: Column) -> Column:
    """All white space at both ends, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _filled(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def record_text(title: Column, abstract: Column) -> Column:
    """Both stripped, empty ones left out, joined by a space."""
    return F.concat_ws(" ", _filled(title), _filled(abstract))


def dotted_text(title: Column, abstract: Column) -> Column:
    """title + ". " + abstract, stripped."""
    return strip(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))))


def raw_text(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def lowered(values: Column) -> Column:
    return F.transform(values, lambda x: F.lower(strip(x)))


def parse_types(value: Column) -> Column:
    """Lower-cased types from a string that holds one type or a written-out list of them; none from null."""
    inner = F.regexp_extract_all(value, F.lit(r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""), F.lit(0))
    listed = F.transform(inner, lambda x: F.lower(F.substring(x, F.lit(2), F.length(x) - 2)))
    return F.when(value.isNull() | (strip(value) == ""), F.array().cast("array<string>")).when(F.regexp_like(value, F.lit(r"^\s*\[.*\]\s*$")), listed).otherwise(F.array(F.lower(strip(value))))


def strict_year(value: Column) -> Column:
    """An integer year from a string; null if it is no number; an error if it is a fraction or a truth value."""
    v = F.lower(strip(value.cast("string")))
    number = v.try_cast("double")
    wrong = v.isin("true", "false") | (number.isNotNull() & (number != F.floor(number)))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("year is not an integer: "), v)).cast("int"))
    return checked.when(F.regexp_like(v, F.lit(r"^[+-]?\d+$")), v.try_cast("int")).when(number.isNotNull(), number.cast("int"))


def lenient_year(value: Column) -> Column:
    return value.try_cast("int")


def evidence_weight(types: Column, weights: dict[str, float]) -> Column:
    """The largest weight of a type, matched exactly; never below 1."""
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
    each = F.transform(F.coalesce(types, F.array().cast("array<string>")), lambda t: F.coalesce(F.try_element_at(table, t), F.lit(1.0)))
    return F.greatest(F.lit(1.0), F.array_max(each))


def high_evidence(types: Column) -> Column:
    """Some type holds one of the high-evidence names, whatever its case."""
    return F.coalesce(F.exists(types, lambda t: F.regexp_like(F.lower(t), F.lit("|".join(HIGH_EVIDENCE)))), F.lit(False))


TOKEN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-cased runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def counted(values: Column) -> Column:
    """(term, tf) of each distinct element of an array, and how often it stands there; sorted, and read by runs."""

    def runs(t: Column) -> Column:
        here = F.when(F.size(t) > 0, F.sequence(F.lit(0), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(here, lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        each = lambda s: F.transform(s, lambda at, i: F.struct(F.get(t, at).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(t)) - at).cast("long").alias("tf")))
        return F.element_at(F.transform(F.array(starts), each), 1)

    return F.element_at(F.transform(F.array(F.sort_array(values)), runs), 1)


def positions(ids: Column, part: list) -> Column:
    """All offsets, from 0, at which ``part`` stands in an array; the array is built once, and read once."""
    k = len(part)

    def starts(t: Column) -> Column:
        here = F.when(F.size(t) >= k, F.sequence(F.lit(0), F.size(t) - k)).otherwise(F.array().cast("array<int>"))
        same = lambda i: functools.reduce(lambda a, b: a & b, [F.get(t, i + j) == F.lit(x) for j, x in enumerate(part)])
        return F.filter(here, same)

    return F.element_at(F.transform(F.array(ids), starts), 1)
