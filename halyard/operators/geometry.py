"""Principal components of a few centroids, and shifts between early and late bins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import series as S


def _components(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores, axes and variance shares of centred rows; each axis points so that the late half lies up."""
    centred = x - x.mean(axis=0)
    u, s, axes = np.linalg.svd(centred, full_matrices=False)
    share = s**2 / (s**2).sum() if s.any() else np.zeros(len(s))
    scores, axes = (u * s)[:, :k], axes[:k]
    ends = min(5, len(x))
    flip = np.where(scores[-ends:].mean(axis=0) < scores[:ends].mean(axis=0), -1.0, 1.0)
    return scores * flip, axes * flip[:, None], share[:k]


def _one_task(centroids: DataFrame, order: str, run, schema: str) -> DataFrame:
    """A row for each calendar bin: a few dozen vectors, in one task."""
    rows = centroids.select(F.lit(0).alias("_one"), F.col(order).cast("long").alias("_x"), "centroid")
    return rows.groupBy("_one").applyInPandas(lambda pdf: run(pdf.sort_values("_x")), schema)


def pca_summary(centroids: DataFrame, order: str = "year", k: int = 3) -> DataFrame:
    """One row: bins, variance shares of the first axes, |tau| of the first axis's scores with the order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, _, share = _components(np.array(pdf["centroid"].tolist(), float), k)
        share = [*share.tolist(), *[0.0] * k][:k]
        points = [{"x": x, "y": y} for x, y in zip(pdf["_x"].astype(float).tolist(), scores[:, 0].tolist(), strict=True)]
        return pd.DataFrame([(len(pdf), *share, points)])

    names = ", ".join(f"pc{i + 1}_variance double" for i in range(k))
    out = _one_task(centroids, order, run, f"n_bins long, {names}, points array<struct<x:double,y:double>>")
    return out.withColumn("pc1_tau", F.abs(S.kendall(F.col("points")))).drop("points")


def pca_scores(centroids: DataFrame, order: str = "year", k: int = 2) -> DataFrame:
    """(x, pc1, pc2, ...) of each bin, later bins up."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        scores, _, _ = _components(np.array(pdf["centroid"].tolist(), float), k)
        return pd.DataFrame({"x": pdf["_x"].to_numpy()} | {f"pc{i + 1}": scores[:, i] for i in range(scores.shape[1])})

    return _one_task(centroids, order, run, "x long, " + ", ".join(f"pc{i + 1} double" for i in range(k)))


def term_loadings(centroids: DataFrame, terms: DataFrame, order: str = "year", k: int = 2, ends: int = 4) -> DataFrame:
    """(axis, end, rank, term, loading): the ``ends`` lowest and highest of (term, vector) on each axis."""
    rows = np.array([r["centroid"] for r in centroids.orderBy(order).select("centroid").collect()], float)  # a row for each bin
    _, axes, _ = _components(rows, k)
    mean = rows.mean(axis=0).tolist()
    moved = F.zip_with(F.col("vector").cast("array<double>"), F.lit(mean), lambda a, b: a - b)
    parts = [F.struct(F.lit(i + 1).alias("axis"), F.aggregate(F.zip_with(moved, F.lit(a.tolist()), lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v).alias("loading")) for i, a in enumerate(axes)]
    each = terms.select("term", F.explode(F.array(*parts)).alias("p")).select("term", "p.*")
    up, down = (Window.partitionBy("axis").orderBy(o, "term") for o in (F.asc("loading"), F.desc("loading")))
    low = each.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= ends).withColumn("end", F.lit("low"))
    high = each.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= ends).withColumn("end", F.lit("high"))
    return low.union(high).select("axis", "end", "rank", "term", "loading")


def early_late_shift(df: DataFrame, keys: list[str], x: str, y: str, ends: int = 5) -> DataFrame:
    """(keys, early, late, shift): means of the first and the last ``ends`` bins; needs that many."""
    w = Window.partitionBy(*keys)
    r = df.withColumn("_a", F.row_number().over(w.orderBy(F.asc(x)))).withColumn("_d", F.row_number().over(w.orderBy(F.desc(x))))
    out = r.groupBy(*keys).agg(F.avg(F.when(F.col("_a") <= ends, F.col(y))).alias("early"), F.avg(F.when(F.col("_d") <= ends, F.col(y))).alias("late"), F.count("*").alias("_n"))
    return out.filter(F.col("_n") >= ends).select(*keys, "early", "late", (F.col("late") - F.col("early")).alias("shift"))


def moving_mean(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """df with ``smooth``: the mean of three bins, an edge's own value standing in for the one beyond it."""
    w = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn("smooth", (F.coalesce(F.lag(y).over(w), F.col(y)) + F.col(y) + F.coalesce(F.lead(y).over(w), F.col(y))) / 3)


def peak(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x, y) of the largest y, the first x among equals."""
    best = F.max_by(F.struct(x, y), F.struct(F.col(y), -F.col(x).cast("double")))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, "_b.*")
