"""How results depend on which query retrieved the records."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions import series as S
from halyard.operators.annual import annual_series
from halyard.operators.corpus import check_keys_equal
from halyard.operators.trend import trend


def explode_membership(queries: DataFrame) -> DataFrame:
    """(case, variant, ord, pmid) from (case, variant, pmids)."""
    return queries.select("case", "variant", F.posexplode("pmids").alias("ord", "pmid"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def check_membership(membership: DataFrame, records: DataFrame, key: str = "pmid") -> None:
    """Every member is a record and every record a member, or an error."""
    check_keys_equal(membership.select(key).distinct(), records.select(key).distinct(), key)


def check_scores(scores: DataFrame, records: DataFrame, columns: list[str], key: str = "pmid", slack: float = 1e-5) -> None:
    """Scores belong to the records' texts, by sha256, and are cosines; else an error."""
    check_keys_equal(scores, records, key)
    bad = scores.filter(F.greatest(F.lit(0.0), *[F.coalesce(F.abs(c), F.lit(9.0)) for c in columns]) > 1 + slack).first()
    if bad is not None:
        raise ValueError(f"score out of range: {bad[key]}")
    other = records.join(scores, key).filter(F.sha2("text", 256) != F.col("text_sha256")).first()
    if other is not None:
        raise ValueError(f"score of another text: {other[key]}")


def set_digests(df: DataFrame, keys: list[str], id: str) -> DataFrame:
    """(keys, n, id_set_sha256): sha256 of each key's distinct ids, sorted as numbers, a line each.

    A digest is of a sequence, so one task reads a key's ids; it reads them as
    a sorted stream and holds none.  Ids are made distinct before.
    """
    rows = df.select(*keys, F.col(id).cast("long").alias("_id")).filter("_id is not null").distinct().repartition(*keys).sortWithinPartitions(*keys, "_id")
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, types = None, None, 0, None

        def told() -> pa.RecordBatch:
            columns = [pa.array([k], t) for k, t in zip(now, types, strict=True)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([n], pa.int64()), pa.array([digest.hexdigest()])], [*keys, "n", "id_set_sha256"])

        for batch in it:
            types = [batch.column(i).type for i in range(len(keys))]
            places = zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)
            for key, group in itertools.groupby(zip(places, batch.column(len(keys)).to_pylist(), strict=True), key=lambda x: x[0]):
                if key != now:
                    if now is not None:
                        yield told()
                    now, digest, n = key, hashlib.sha256(), 0
                ids = [str(i) for _, i in group]
                digest.update((("\n" if n else "") + "\n".join(ids)).encode())
                n += len(ids)
        if now is not None:
            yield told()

    return rows.mapInArrow(run, ", ".join([*fields, "n long, id_set_sha256 string"]))


def variants(members: DataFrame, keys: list[str], id: str = "doc_id", value: str = "cos", floor: int = 5) -> DataFrame:
    """(keys, raw_records, analyzed_records, n_years, tau, direction, id_set_sha256) of members (keys, id, year, value)."""
    ids = set_digests(members, keys, id).withColumnRenamed("n", "raw_records")
    annual = annual_series(members, keys, value, floor)
    n = annual.groupBy(*keys).agg(F.sum("n").cast("long").alias("analyzed_records"))
    t = trend(annual, keys).select(*keys, F.col("n_points").alias("n_years"), "tau")
    out = ids.join(n, keys).join(t, keys)
    return out.withColumn("direction", S.direction(F.col("tau"), 0.05, ("negative", "positive", "flat")))


def query_summary(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_variants, unique_sets, tau_min, tau_max, negative, positive) over variants."""
    return results.groupBy(*keys).agg(
        F.count("*").cast("long").alias("n_variants"),
        F.count_distinct("id_set_sha256").cast("long").alias("unique_sets"),
        F.min("tau").alias("tau_min"),
        F.max("tau").alias("tau_max"),
        F.count_if(F.col("tau") < 0).cast("long").alias("negative"),
        F.count_if(F.col("tau") > 0).cast("long").alias("positive"),
    )
