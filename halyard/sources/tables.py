"""Readers and writers of archives, vectors and result tables."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from halyard.operators.corpus import check_count

_STRINGS = T.ArrayType(T.StringType())

#: A record as its archive holds it.  A year may be a number or a string there, so it is read as a string.
RECORD = T.StructType(
    [
        T.StructField("pmid", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("journal", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("mesh_major", _STRINGS),
        T.StructField("publication_types", _STRINGS),
        T.StructField("languages", _STRINGS),
        T.StructField("record_type", T.StringType()),
        T.StructField("exclusion", T.StringType()),
    ]
)


def read_records(spark: SparkSession, path: str, declared: int | None = None) -> DataFrame:
    """Records of a JSON array or of JSON lines, gzipped or not.  One array is one task: it cannot be split."""
    df = spark.read.schema(RECORD).option("multiLine", True).json(path)
    return df if declared is None else check_count(df, declared, "records")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_config(path: str) -> dict:
    return json.loads(Path(path).read_text())


def read_npy(spark: SparkSession, path: str, width: int | None = None) -> DataFrame:
    """(path, row, vector) of the rows of .npy files; a file of one dimension has one row.  Files are read whole."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False))
                if width is not None and rows.shape[1] != width:
                    raise ValueError(f"{name}: vectors of {rows.shape[1]}, {width} expected")
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    yield pd.DataFrame({"path": name, "row": np.arange(at, at + len(part)), "vector": list(part.astype(np.float64))})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, row long, vector array<double>")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def verify_checksums(spark: SparkSession, declared: dict[str, str]) -> None:
    """An error naming the files whose content is not as declared."""
    wrong = [p for p, digest in declared.items() if checksums(spark, p).first()["sha256"] != digest]
    if wrong:
        raise ValueError(f"content differs: {wrong}")


def write_csv(df: DataFrame, path: str, overwrite: bool = True) -> None:
    """One CSV file with a header, of a small result table."""
    df.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, *by: str, overwrite: bool = False) -> None:
    """Never over what is there, unless told to."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Gzipped JSON lines."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "gzip").json(path)


def land_raw(payloads: DataFrame, path: str) -> None:
    """Keep raw replies (name, payload) as they came, with their sha256; never over what is there."""
    raw = payloads.select("name", F.col("payload").cast("binary").alias("payload"))
    raw.withColumn("sha256", F.sha2("payload", 256)).write.mode("errorifexists").parquet(path)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(name, payload) of landed replies; content that does not have its sha256 any more is an error."""
    raw = spark.read.parquet(path)
    fault = F.raise_error(F.concat(F.lit("content differs: "), F.col("name"))).cast("binary")
    return raw.select("name", F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(fault).alias("payload"))


def write_json_array(df: DataFrame, path: str) -> None:
    """A small table as one JSON array in one text file."""
    rows = df.select(F.to_json(F.struct(*df.columns)).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    rows.coalesce(1).write.mode("errorifexists").text(path)
