"""The reference model laid over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import vectors as V
from halyard.functions.text import evidence_weight

#: Weights of publication types.
WEIGHTS = {"high": 3.0}
ANCHORS = (0, 1, 2)
OTHER_ANCHOR = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def year_of(source: Column) -> Column:
    return (F.lit(2000) + F.substring(source, 4, 10).cast("int")).cast("int")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, year, label, embedding) of English documents that have a vector."""
    d = read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", year_of(F.col("source")).alias("year"))
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding")
    return d.join(e, "doc_id")


def anchor(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One vector, a constant of the query: it becomes a literal of the plan."""
    return [float(x) for x in read(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def scored(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    """(doc_id, year, label, cos): the corpus with its cosine to an anchor."""
    cos = V.cosine(F.col("embedding"), F.lit(anchor(spark, sf_dir, vec_id)))
    return corpus(spark, sf_dir).select("doc_id", "year", "label", cos.alias("cos"))


def typed(spark: SparkSession, sf_dir: str, df: DataFrame) -> DataFrame:
    """df with ``types``, ``excluded`` and ``weight`` by the labels: toxic is an excluded type, quality evidence."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    types = F.filter(F.array(F.when(F.col("quality") == 1, "high"), F.when(F.col("toxic") == 1, "editorial")), lambda t: t.isNotNull())
    out = df.join(labels, "doc_id", "left").withColumn("types", types)
    return out.withColumn("excluded", F.array_contains("types", "editorial")).withColumn("weight", evidence_weight(F.col("types"), WEIGHTS)).drop("quality", "toxic")


#: The same, for DuckDB.
SQL = """
corpus AS (
  SELECT d.doc_id, (2000 + CAST(substr(d.source, 4) AS INT))::INT AS year, e.label, CAST(e.embedding AS DOUBLE[]) AS v
  FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id WHERE d.lang = 'en'
), anchors AS (SELECT vec_id AS anchor, CAST(embedding AS DOUBLE[]) AS a FROM embeddings WHERE vec_id IN (0, 1, 2, 3)
), scored AS (
  SELECT doc_id, year, label, v, anchor, list_cosine_similarity(v, a) AS cos FROM corpus, anchors
), typed AS (
  SELECT s.*, coalesce(l.toxic = 1, false) AS excluded, CASE WHEN l.quality = 1 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM scored s LEFT JOIN labels l USING (doc_id)
), annual AS (
  SELECT anchor, year, count(*)::BIGINT AS n, avg(cos) AS mean, stddev_samp(cos) / sqrt(count(*)) AS se
  FROM scored WHERE year BETWEEN 2000 AND 2024 GROUP BY anchor, year HAVING count(*) >= 5
)"""


def trend_sql(source: str, keys: list[str], x: str = "year", y: str = "mean") -> str:
    """SELECT of keys, n_points, tau and slope of series in ``source``, by a self-join of its points."""
    on = " AND ".join([f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys] + [f"a.{x} < b.{x}"])
    head = "".join(f"a.{k} AS {k}, " for k in keys)
    group = f"GROUP BY {', '.join(f'a.{k}' for k in keys)}" if keys else "HAVING count(*) > 0"
    return f"""SELECT {head}((1 + sqrt(1 + 8 * count(*))) / 2)::BIGINT AS n_points,
  sum(sign(b.{y} - a.{y})) / nullif(sqrt(count(*) * sum((a.{y} <> b.{y})::INT)), 0) AS tau,
  median((b.{y} - a.{y}) / (b.{x} - a.{x})) AS slope
FROM {source} a JOIN {source} b ON {on} {group}"""


def r(expr: str, name: str, places: int = 6) -> str:
    return f"round({expr}, {places}) + 0.0 AS {name}"
