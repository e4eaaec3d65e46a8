"""Resampling with draws that any engine can repeat: they are digits of md5 over a row's number and the replicate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import series as S
from halyard.operators.corpus import with_ordinal


def draw(*parts: Column) -> Column:
    """A number below 2**32 from the md5 of the parts, joined by dashes."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _replicates(df: DataFrame, count: int) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(count))))


#: Rows of a replicate that one task sorts.
SORTED = 200_000


def _ranked(reps: DataFrame, rows: int) -> DataFrame:
    """reps (rep, id, d, ...) with k, the place of (d, id) within its replicate, from 0.

    Draws are dealt to ranges of about SORTED rows; a row's place is its place
    in the range and the sizes of the ranges before, so no task sorts a replicate.
    """
    ranges = -(-rows // SORTED) or 1
    part = F.floor(F.col("d") * ranges / (1 << 32)).cast("int")
    dealt = reps.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("rep", "part").orderBy("d", "id")) - 1)
    if ranges == 1:
        return dealt.drop("part")
    before = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = reps.groupBy("rep", part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return dealt.join(sizes.drop("n"), ["rep", "part"]).withColumn("k", F.col("k") + F.col("before")).drop("part", "before")


def year_shuffle(df: DataFrame, observed: float, replicates: int, floor: int = 5, id: str = "doc_id", value: str = "cos") -> DataFrame:
    """One row (replicates, exceed, p): how often shuffled years give a tau as large.

    Values are numbered once, by id; in each replicate the year with the k-th
    least draw goes to the k-th value.
    """
    rows = with_ordinal(df.select("year", F.col(value).alias("v"), F.col(id).alias("id")), "id", name="at")
    reps = _replicates(rows.select("year", "id"), replicates).withColumn("d", draw(F.col("id"), F.col("rep")))
    years = _ranked(reps, rows.count()).select("rep", "year", "k")
    values = rows.select("v", F.col("at").alias("k"))
    annual = years.join(values, "k").groupBy("rep", "year").agg(F.avg("v").alias("mean"), F.count("*").alias("n")).filter(F.col("n") >= floor)
    taus = annual.groupBy("rep").agg(S.series(F.col("year"), F.col("mean")).alias("p")).select(S.kendall(F.col("p")).alias("tau"))
    exceed = F.count_if(F.abs("tau") >= abs(observed) - 1e-12).cast("long")
    return taus.agg(F.count("*").cast("long").alias("replicates"), exceed.alias("exceed")).withColumn("p", S.add_one_p(F.col("exceed"), F.col("replicates")))


def bootstrap_means(df: DataFrame, replicates: int, id: str = "doc_id", value: str = "cos") -> DataFrame:
    """(rep, year, mean): each bin's rows drawn with replacement, as many as it holds.

    Rows are numbered once, in the order of (year, id); a bin is a run of
    numbers, so its first number and its size, a row a bin, say what its
    draws stand for.
    """
    rows = with_ordinal(df.select("year", F.col(value).alias("v"), F.col(id).alias("id")), "year", "id", name="at")
    bins = F.broadcast(rows.groupBy("year").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    slots = _replicates(rows.select("year", "at").join(bins, "year"), replicates)
    k = F.col("at") - F.col("first") + 1
    drawn = slots.select("rep", "year", (F.col("first") + draw(F.col("year"), k, F.col("rep")) % F.col("n")).alias("at"))
    # How often a value was drawn is summed before it meets the value.
    times = drawn.groupBy("rep", "year", "at").agg(F.count("*").alias("times"))
    return times.join(rows.select("at", "v"), "at").groupBy("rep", "year").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("mean"))


def bootstrap_lines(means: DataFrame) -> DataFrame:
    """(rep, tau, slope, intercept, years) of each replicate's series."""
    g = means.groupBy("rep").agg(S.series(F.col("year"), F.col("mean")).alias("p"))
    g = g.withColumn("tau", S.kendall(F.col("p"))).withColumn("slope", S.theil_sen(F.col("p")))
    return g.select("rep", "tau", "slope", S.intercept(F.col("p"), F.col("slope")).alias("intercept"), F.transform("p", lambda q: q["x"].cast("int")).alias("years"))


def same_sign(lines: DataFrame, observed: float) -> DataFrame:
    """One row: the percentage of replicates whose tau has the observed sign."""
    return lines.agg(F.count("*").cast("long").alias("replicates"), (100.0 * F.count_if(F.signum("tau") == float((observed > 0) - (observed < 0))) / F.count("*")).alias("same_sign_pct"))


def tau_range(lines: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    return lines.agg(F.percentile("tau", F.lit(low)).alias("tau_low"), F.percentile("tau", F.lit(high)).alias("tau_high"))


def trend_band(lines: DataFrame, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(year, low, high): percentiles of the replicates' lines at each year."""
    at = lines.select(F.explode("years").alias("year"), "slope", "intercept").withColumn("v", F.col("intercept") + F.col("slope") * F.col("year"))
    return at.groupBy("year").agg(F.percentile("v", F.lit(low)).alias("low"), F.percentile("v", F.lit(high)).alias("high"))


def amplitudes(ys: Column) -> Column:
    """|sum of y(t) exp(-2 pi i k t / n)| for k = 1 .. n/2, of an array."""
    n = F.size(ys)

    def part(k: Column, wave) -> Column:
        terms = F.transform(ys, lambda y, t: y * wave(F.lit(2 * math.pi) * k * t / n))
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)

    return F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), lambda k: F.hypot(part(k, F.cos), part(k, F.sin)))


def phase_surrogate(ys: Column, waves: Column, phases: Column) -> Column:
    """A series with the mean and the amplitudes of ``ys`` and other phases: the sum of its waves.

    The wave that changes sign at every step, of an even length, has phase 0.
    """
    n = F.size(ys)
    mean = F.aggregate(ys, F.lit(0.0), lambda a, y: a + y) / n

    def made(bound: Column) -> Column:
        def at(t: Column) -> Column:
            def wave(amplitude: Column, i: Column) -> Column:
                k = i + 1
                last = k * 2 == n
                turn = F.lit(2 * math.pi) * k * t / n + F.when(last, F.lit(0.0)).otherwise(F.get(bound["phases"], i))
                return amplitude * F.cos(turn) * F.when(last, F.lit(1.0)).otherwise(F.lit(2.0)) / n

            return F.aggregate(F.transform(waves, wave), bound["mean"], lambda a, w: a + w)

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    # As an element of an array the phases and the mean are computed once, not for each point.
    return F.element_at(F.transform(F.array(F.struct(phases.alias("phases"), mean.alias("mean"))), made), 1)


def phase_null(df: DataFrame, keys: list[str], x: str = "year", y: str = "mean", replicates: int = 5000) -> DataFrame:
    """(keys, n_points, tau, exceed, replicates, p): how often a series with the same spectrum and random phases has a tau as large.

    A series is a few dozen points in one row; its replicates are rows of
    their own, dealt to all tasks.  Phases are draws of the keys, the wave and
    the replicate.
    """
    g = df.groupBy(*keys).agg(S.series(F.col(x), F.col(y)).alias("p")).filter(F.size("p") >= 2)
    g = g.withColumn("ys", F.transform("p", lambda q: q["y"])).withColumn("tau", S.kendall(F.col("p"))).withColumn("waves", amplitudes(F.col("ys")))
    reps = _replicates(g, replicates).repartition(*keys, "rep")
    phases = F.transform("waves", lambda _, i: draw(*[F.col(k) for k in keys], i + 1, F.col("rep")) * (2 * math.pi / (1 << 32)))
    made = reps.withColumn("made", F.explode(F.array(phase_surrogate(F.col("ys"), F.col("waves"), phases))))
    far = F.abs(S.own_order_tau(F.col("made"))) >= F.abs("tau") - 1e-12
    told = made.select(*keys, F.size("p").cast("long").alias("n_points"), "tau", far.alias("far"))
    counts = [F.count_if("far").cast("long").alias("exceed"), F.count("*").cast("long").alias("replicates")]
    out = told.groupBy(*keys, "n_points", "tau").agg(*counts)
    return out.withColumn("p", S.add_one_p(F.col("exceed"), F.col("replicates")))


def sample_per_bin(df: DataFrame, keys: list[str], most: int, id: str = "doc_id", seed: int = 0) -> DataFrame:
    """At most ``most`` rows of each bin, by draw."""
    w = Window.partitionBy(*keys).orderBy(draw(F.col(id), F.lit(seed)), id)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


def capped_occurrences(hits: DataFrame, order: list[Column | str], each: int = 2, total: int = 200, id: str = "doc_id") -> DataFrame:
    """(id, kept) of documents with ``hits`` occurrences, at most ``each`` of one, until the document that reaches ``total``.

    Only the first ``total`` documents in the order can matter, so the running
    sum is over that many rows, not over all.
    """
    few = hits.select(F.col(id), F.least("hits", F.lit(each)).cast("long").alias("kept"), *[(F.col(o) if isinstance(o, str) else o).alias(f"_o{i}") for i, o in enumerate(order)]).filter("kept > 0")
    names = [f"_o{i}" for i in range(len(order))]
    first = few.orderBy(*names).limit(total)
    w = Window.partitionBy(F.lit(0)).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    return first.withColumn("_before", F.coalesce(F.sum("kept").over(w), F.lit(0))).filter(F.col("_before") < total).select(id, "kept")

