"""Selection of dated records, their checks and their audits."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.text import lowered, record_text, strict_year, strip

#: Names of the language that records are kept for.
ENGLISH = ("en", "eng", "english")


def in_language(languages: Column, names: tuple[str, ...] = ENGLISH) -> Column:
    """Some language is one of ``names``; a record without languages is not."""
    return F.coalesce(F.arrays_overlap(lowered(languages), F.array(*map(F.lit, names))), F.lit(False))


def without_types(types: Column, excluded: list[str]) -> Column:
    if not excluded:
        return F.lit(True)
    return ~F.coalesce(F.arrays_overlap(lowered(types), F.array(*[F.lit(x.strip().lower()) for x in excluded])), F.lit(False))


def select_records(records: DataFrame, excluded: list[str]) -> DataFrame:
    """Records (pmid, title, abstract, year, languages, publication_types) that may be analyzed, with their text.

    Language first, then types, then a whole year, an id and a text.  A year
    that is a fraction or a truth value is an error, and so is an id that is
    kept twice; see check_unique.
    """
    kept = records.filter(in_language(F.col("languages")) & without_types(F.col("publication_types"), excluded))
    kept = kept.withColumn("year", strict_year(F.col("year"))).withColumn("text", record_text(F.col("title"), F.col("abstract")))
    return kept.filter((F.coalesce(strip(F.col("pmid").cast("string")), F.lit("")) != "") & (F.col("text") != "") & F.col("year").isNotNull())


def check_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or an error if a key occurs twice.  The check is an action, so that no later pruning can skip it."""
    twice = df.groupBy(*keys).count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"key occurs {twice['count']} times: {twice.asDict()}")
    return df


def check_count(df: DataFrame, declared: int, what: str = "rows") -> DataFrame:
    found = df.count()
    if found != declared:
        raise ValueError(f"{found} {what}, {declared} declared")
    return df


def check_keys_equal(left: DataFrame, right: DataFrame, *keys: str) -> None:
    """An error unless both hold the same keys."""
    for a, b, side in ((left, right, "left"), (right, left, "right")):
        alone = a.select(*keys).join(b.select(*keys), list(keys), "left_anti").first()
        if alone is not None:
            raise ValueError(f"only on the {side}: {alone.asDict()}")


#: Rows of a range that with_ordinal sorts at once, and keys read for each bound between ranges.
RANGE, KEYS = 5_000, 50


def _ranges(df: DataFrame, order: tuple[str, ...], most: int) -> Column:
    """The range, from 0, that a row's key falls into: a function of the key alone.

    Bounds are quantiles of keys drawn by hash, and literals of the plan.  They
    make ranges about even; which keys are drawn decides nothing else.
    """
    rows = df.count()
    ranges = min(most, -(-rows // RANGE))
    if ranges < 2:
        return F.lit(0)
    drawn = df.select(*order).filter(F.pmod(F.xxhash64(*order), F.lit(max(1, rows // (ranges * KEYS)))) == 0)
    keys = drawn.distinct().orderBy(*order).collect()
    bounds = [keys[i] for i in sorted({len(keys) * k // ranges for k in range(1, ranges)})] if keys else []
    key = F.struct(*[F.col(o) for o in order])

    def tree(low: int, high: int) -> Column:
        """The number of bounds at or below the key, which are at least ``low`` and at most ``high``."""
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        bound = F.struct(*[F.lit(bounds[mid][i]).cast(df.schema[o].dataType).alias(o) for i, o in enumerate(order)])
        return F.when(key < bound, tree(low, mid)).otherwise(tree(mid + 1, high))

    return tree(0, len(bounds))


def with_ordinal(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Row numbers from 0 in a total order, without one task that sees all rows.

    A row's place is its place in its range and the sizes of the ranges before.
    The range is a function of the row's key, not of the task that holds it: a
    plan that is run again, or in part, gives each row the same number.
    (repartitionByRange draws its bounds anew each time it runs.)  Only the
    sizes of the ranges and the keys that bounds are made of come to the driver.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = _ranges(df, order, most)
    sizes = {r["p"]: r["n"] for r in df.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    table = F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]) if offsets else F.create_map().cast("map<int,bigint>")
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    ranged = df.withColumn("_p", part).withColumn("_k", place)
    return ranged.withColumn(name, (F.coalesce(F.try_element_at(table, F.col("_p")), F.lit(0)) + F.col("_k")).cast("long")).drop("_p", "_k")


def in_window(year: Column, first: int = 2000, last: int = 2024) -> Column:
    return F.coalesce(year.between(first, last), F.lit(False))


def floor_mask(df: DataFrame, keys: list[str], floor: int = 5, first: int = 2000, last: int = 2024) -> DataFrame:
    """df with ``analyzed``: the row's year is in the window and its bin has ``floor`` rows.

    Bins are counted where their rows are, and the counts, a row a bin, come to
    the rows: these are never shuffled by a few dozen years.
    """
    inside = in_window(F.col("year"), first, last)
    bins = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "year"])]
    counts = df.filter(inside).groupBy(*bins).agg((F.count("*") >= floor).alias("_enough"))
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "year"])])
    met = df.join(F.broadcast(counts), same, "left")
    return met.withColumn("analyzed", (inside & F.coalesce("_enough", F.lit(False))).cast("int")).drop("_enough", *(f"_k{i}" for i in range(len(bins))))


def at_least(df: DataFrame, keys: list[str], least: int, name: str = "n") -> DataFrame:
    """(keys, name) of the keys that occur ``least`` times."""
    return df.groupBy(*keys).agg(F.count("*").cast("long").alias(name)).filter(F.col(name) >= least)


def funnel(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts along the selection, from rows with booleans excluded, embedded, title_only, in_window, analyzed and a year."""
    count = lambda c: F.count_if(c).cast("long")
    return records.groupBy(*keys).agg(
        F.count("*").cast("long").alias("raw"),
        count(F.col("excluded")).alias("excluded"),
        count(F.col("embedded")).alias("embedded"),
        count(F.col("embedded") & F.col("title_only")).alias("title_only"),
        count(F.col("embedded") & ~F.col("in_window")).alias("outside_window"),
        count(F.col("embedded") & F.col("in_window") & ~F.col("analyzed")).alias("below_floor"),
        count(F.col("analyzed")).alias("analyzed"),
        F.count_distinct(F.when(F.col("analyzed"), F.col("year"))).cast("long").alias("years"),
    )


def alignment(left: DataFrame, right: DataFrame, key: str, compare: dict[str, tuple[str, str]]) -> DataFrame:
    """One row: rows matched and alone on either side, and mismatches of compared columns among the matched."""
    a, b = left.alias("a"), right.alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    at_a, at_b = F.col(f"a.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()
    out = [F.count_if(at_a & at_b).alias("matched"), F.count_if(at_a & ~at_b).alias("left_only"), F.count_if(~at_a & at_b).alias("right_only")]
    out += [F.count_if(at_a & at_b & ~F.col(f"a.{x}").eqNullSafe(F.col(f"b.{y}"))).alias(name) for name, (x, y) in compare.items()]
    return both.agg(*out)
