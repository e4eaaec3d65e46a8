"""Series by calendar bin: means, weights, volumes, centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.functions import vectors as V
from halyard.operators.corpus import in_window


def annual_series(df: DataFrame, keys: list[str], value: str = "cos", floor: int = 5, first: int = 2000, last: int = 2024, bin: str = "year") -> DataFrame:
    """(keys, bin, n, mean, standard_error) of bins with ``floor`` rows; the error has n - 1 degrees of freedom."""
    inside = df.filter(in_window(F.col(bin), first, last)) if first is not None else df
    out = inside.groupBy(*keys, bin).agg(F.count("*").cast("long").alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count("*"))).alias("standard_error"))
    return out.filter(F.col("n") >= floor)


def weighted_series(df: DataFrame, keys: list[str], value: str = "cos", weight: str = "weight", floor: int = 5, first: int = 2000, last: int = 2024) -> DataFrame:
    """(keys, year, n, weight_sum, mean, weighted_mean); a weight that is not finite and positive is an error."""
    w = F.when(F.col(weight) > 0, V.finite(F.col(weight), "weight")).otherwise(F.raise_error(F.lit("weight is not positive")).cast("double"))
    rows = df.filter(in_window(F.col("year"), first, last)).withColumn("_w", w).withColumn("_v", V.finite(F.col(value), "value"))
    weighted = F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")
    sums = [F.count("*").cast("long").alias("n"), F.sum("_w").alias("weight_sum"), F.avg("_v").alias("mean"), weighted.alias("weighted_mean")]
    out = rows.groupBy(*keys, "year").agg(*sums)
    return out.filter(F.col("n") >= floor)


def volumes(df: DataFrame, keys: list[str], high: str, first: int = 2000, last: int = 2024) -> DataFrame:
    """(keys, year, n, high): rows and rows of high evidence."""
    return df.filter(in_window(F.col("year"), first, last)).groupBy(*keys, "year").agg(F.count("*").cast("long").alias("n"), F.count_if(F.col(high)).cast("long").alias("high"))


def centroids(df: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """(keys, n, centroid): mean vectors, of vectors of one width for each key.

    Each task adds up the vectors of a key as they pass and hands on one sum,
    so a bin of any size is never gathered; the sums, one for each key and
    task, are added by position.
    """
    names = [*keys, "_n", "_v"]
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = (fields + ", " if fields else "") + "_n long, _v array<double>"
    rows = df.select(*keys, V.doubles(F.col(vector)).alias("_v")).filter(F.col("_v").isNotNull())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list] = {}
        for batch in it:
            lists = batch.column(len(keys))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(len(keys))), strict=True) if keys else [()] * len(batch)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                widths = {int(ends[i + 1] - ends[i]) for i in at}
                if len(widths) > 1 or (key in sums and len(sums[key][1]) not in widths):
                    raise ValueError(f"vectors of different widths under {key}")
                total = flat[np.concatenate([np.arange(ends[i], ends[i + 1]) for i in at])].reshape(len(at), -1).sum(axis=0)
                if key in sums:
                    sums[key][0] += len(at)
                    sums[key][1] += total
                else:
                    sums[key] = [len(at), total]
        if sums:
            columns = [pa.array([k[c] for k in sums], df_types[c]) for c in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in sums.values()], pa.int64()), pa.array([v.tolist() for _, v in sums.values()], pa.list_(pa.float64()))], names)

    from pyspark.sql.pandas.types import to_arrow_type

    df_types = [to_arrow_type(df.schema[k].dataType) for k in keys]
    part = rows.mapInArrow(run, schema)
    n = part.groupBy(*keys).agg(F.sum("_n").cast("long").alias("n"))
    each = part.select(*keys, F.posexplode("_v").alias("_j", "_x")).groupBy(*keys, "_j").agg(F.sum("_x").alias("_s"))
    gathered = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_j", "_s"))).alias("_c"))
    both = gathered.join(n, keys) if keys else gathered.join(n)
    return both.select(*keys, "n", F.transform("_c", lambda x: x["_s"] / F.col("n")).alias("centroid"))


def decomposition(df: DataFrame, keys: list[str], anchor: list[float], vector: str = "embedding", floor: int = 5) -> DataFrame:
    """(keys, n, mean_cosine, centroid_norm, centroid_anchor_cosine): for unit vectors the first is the product of the others."""
    a = V.unit(F.lit(anchor))
    unit = df.withColumn("_u", V.unit(F.col(vector)))
    c = centroids(unit, keys, "_u").filter(F.col("n") >= floor)
    length = V.norm(F.col("centroid"))
    along = V.dot(F.col("centroid"), a)
    angle = along / F.nullif(length, F.lit(0.0))
    return c.select(*keys, "n", along.alias("mean_cosine"), length.alias("centroid_norm"), angle.alias("centroid_anchor_cosine"))
