"""Trends of series and how far they depend on choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions import series as S


def gather(df: DataFrame, keys: list[str], x: str = "year", **ys: str) -> DataFrame:
    """(keys, one array of points for each name): a row for each series."""
    aggs = [S.series(F.col(x), F.col(y)).alias(name) for name, y in ys.items()]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def trend(df: DataFrame, keys: list[str], x: str = "year", y: str = "mean", least: int = 2) -> DataFrame:
    """(keys, n_points, tau, slope) of series with ``least`` points: Kendall's tau-b and the Theil-Sen slope."""
    g = gather(df, keys, x, points=y).filter(F.size("points") >= least)
    return g.select(*keys, F.size("points").cast("long").alias("n_points"), S.kendall(F.col("points")).alias("tau"), S.theil_sen(F.col("points")).alias("slope"))


def floor_sweep(df: DataFrame, keys: list[str], floors: list[int], x: str = "year", y: str = "mean", n: str = "n", least: int = 4) -> DataFrame:
    """(keys, floor, n_points, tau, direction) for each floor; tau is null with fewer than ``least`` points.

    Every floor reads the same series: bins are counted once and kept or not
    by an array filter.
    """
    point = F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(n).alias("n"))
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("_all")).withColumn("floor", F.explode(F.array(*map(F.lit, floors))))
    kept = g.withColumn("_p", F.filter("_all", lambda p: p["n"] >= F.col("floor"))).withColumn("tau", F.when(F.size("_p") >= least, S.kendall(F.col("_p"))))
    return kept.select(*keys, "floor", F.size("_p").cast("long").alias("n_points"), "tau", F.when(F.col("tau").isNotNull(), S.direction(F.col("tau"))).alias("direction"))


def leave_one_out(df: DataFrame, keys: list[str], x: str = "year", y: str = "mean") -> DataFrame:
    """(keys, n_points, tau, tau_min, tau_max) when each point in turn is left out."""
    g = gather(df, keys, x, points=y).filter(F.size("points") >= 3)
    each = F.transform(F.sequence(F.lit(0), F.size("points") - 1), lambda i: S.kendall(F.filter("points", lambda p, j: j != i)))
    return g.select(*keys, F.size("points").cast("long").alias("n_points"), S.kendall(F.col("points")).alias("tau"), F.array_min(each).alias("tau_min"), F.array_max(each).alias("tau_max"))


def partial_kendall(df: DataFrame, keys: list[str], x: str = "year", y: str = "mean", z: str = "n") -> DataFrame:
    """(keys, n_points, tau_xy, tau_xz, tau_yz, partial, direction) of y against x given z."""
    point = lambda a, b: S.series(F.col(a), F.col(b))
    g = df.groupBy(*keys).agg(point(x, y).alias("_xy"), point(x, z).alias("_xz"))
    # The order of y's points is x's, so z against y pairs the two arrays by position.
    g = g.withColumn("_yz", F.zip_with("_xy", "_xz", lambda p, q: F.struct(p["y"].alias("x"), q["y"].alias("y"))))
    out = g.filter(F.size("_xy") >= 3).select(*keys, F.size("_xy").cast("long").alias("n_points"), *[S.kendall(F.col(f"_{c}")).alias(f"tau_{c}") for c in ("xy", "xz", "yz")])
    partial = S.partial_tau(F.col("tau_xy"), F.col("tau_xz"), F.col("tau_yz"))
    return out.withColumn("partial", partial).withColumn("direction", S.direction(F.col("partial"), 0.05))


def regress_on_volume(df: DataFrame, keys: list[str], x: str = "year", y: str = "mean", n: str = "n") -> DataFrame:
    """(keys, n_points, beta_x, beta_volume, t_x, t_volume, dof) of y on standardized x and log volume.

    Closed form from one aggregation: with standardized regressors the normal
    equations hold only their correlation and their covariances with y.
    """
    rows = df.withColumns({"_x": F.col(x).cast("double"), "_v": F.log(F.col(n)), "_y": F.col(y)})
    g = rows.groupBy(*keys).agg(
        F.count("*").cast("long").alias("n_points"),
        F.corr("_x", "_v").alias("_r"),
        F.covar_pop("_x", "_y").alias("_cx"),
        F.covar_pop("_v", "_y").alias("_cv"),
        F.stddev_pop("_x").alias("_sx"),
        F.stddev_pop("_v").alias("_sv"),
        F.var_pop("_y").alias("_vy"),
    )
    a, b, r = F.col("_cx") / F.nullif("_sx", F.lit(0.0)), F.col("_cv") / F.nullif("_sv", F.lit(0.0)), F.col("_r")
    free = F.nullif(1 - r * r, F.lit(0.0))
    g = g.filter("n_points > 3").withColumns({"beta_x": (a - r * b) / free, "beta_volume": (b - r * a) / free, "_a": a, "_b": b, "dof": F.col("n_points") - 3})
    rss = F.col("n_points") * (F.col("_vy") - F.col("beta_x") * F.col("_a") - F.col("beta_volume") * F.col("_b"))
    se = F.sqrt(F.greatest(rss, F.lit(0.0)) / F.col("dof") / F.col("n_points") / free)
    return g.select(*keys, "n_points", "beta_x", "beta_volume", (F.col("beta_x") / F.nullif(se, F.lit(0.0))).alias("t_x"), (F.col("beta_volume") / F.nullif(se, F.lit(0.0))).alias("t_volume"), "dof")


def regress_clustered(df: DataFrame, keys: list[str], x: str = "year", y: str = "cos") -> DataFrame:
    """(keys, n, clusters, slope, standard_error, t) of rows' y on x, errors clustered by x (CR1).

    Two passes: the fit, then sums of scores by cluster; both are map-side
    aggregations.
    """
    fit = df.groupBy(*keys).agg(F.count("*").cast("long").alias("n"), F.regr_slope(y, x).alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), (F.var_pop(x) * F.count("*")).alias("_sxx"))
    # Within a cluster x is one value, so its score is a multiple of its summed residual.
    bins = df.groupBy(*keys, F.col(x).alias("_x")).agg(F.count("*").alias("_n"), F.sum(y).alias("_s"))
    on = bins.join(fit, keys) if keys else bins.crossJoin(F.broadcast(fit))
    residual = F.col("_s") - F.col("_n") * (F.col("_my") + F.col("slope") * (F.col("_x") - F.col("_mx")))
    score = (F.col("_x") - F.col("_mx")) * residual
    g = on.groupBy(*keys, "n", "slope", "_sxx").agg(F.count("*").cast("long").alias("clusters"), F.sum(score * score).alias("_meat"))
    correction = F.col("clusters") / (F.col("clusters") - 1) * (F.col("n") - 1) / (F.col("n") - 2)
    g = g.filter("clusters > 1 and n > 2").withColumn("standard_error", F.sqrt(correction * F.col("_meat")) / F.nullif("_sxx", F.lit(0.0)))
    return g.select(*keys, "n", "clusters", "slope", "standard_error", (F.col("slope") / F.nullif("standard_error", F.lit(0.0))).alias("t"))
