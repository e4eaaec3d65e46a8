"""TF-IDF similarity of texts to an anchor, relationally."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from halyard.functions.text import counted, tokens


def term_counts(docs: DataFrame, keys: list[str], text: str = "text", stop: list[str] | None = None) -> DataFrame:
    """(keys, term, tf): how often each token occurs in each text."""
    each = docs.select(*keys, F.explode(tokens(F.col(text))).alias("term"))
    if stop:
        each = each.filter(~F.col("term").isin(stop))
    return each.groupBy(*keys, "term").agg(F.count("*").cast("long").alias("tf"))


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, year, term, tf, fresh, head) of docs (doc_id, year, text): term counts, each text's made within its row.

    ``fresh`` is 1 in one row of each document and term, ``head`` in one row of
    each document, so their sums are numbers of documents.  Nothing is grouped
    by document, except those whose id stands in more than one row.
    """
    each = docs.select("doc_id", "year", F.posexplode_outer(counted(tokens(F.col("text")))).alias("_i", "_c")).filter(F.col("_i").isNotNull())
    each = each.select("doc_id", "year", "_c.term", "_c.tf", F.lit(1).alias("fresh"), ((F.col("_i") == 0) & F.col("doc_id").isNotNull()).cast("int").alias("head"))
    repeated = docs.groupBy(F.col("doc_id").alias("_d")).count().filter("count > 1").select("_d")
    if repeated.isEmpty():
        return each
    same = F.col("doc_id").eqNullSafe(F.col("_d"))
    first = lambda w: (F.row_number().over(w) == 1)
    more = each.join(repeated, same, "left_semi").groupBy("doc_id", "year", "term").agg(F.sum("tf").alias("tf"))
    more = more.withColumn("fresh", first(Window.partitionBy("doc_id", "term").orderBy("year")).cast("int"))
    more = more.withColumn("head", (first(Window.partitionBy("doc_id").orderBy("term", "year")) & F.col("doc_id").isNotNull()).cast("int"))
    return each.join(repeated, same, "left_anti").unionByName(more)


def inverse_frequencies(counts: DataFrame, unit: list[str], least: int) -> DataFrame:
    """(term, idf) of terms in ``least`` units: ln((1 + N) / (1 + df)) + 1.  Kept, as it is read more than once."""
    units = counts.select(*unit, "term").distinct()
    n = counts.select(*unit).distinct().count()
    return _idf(units.groupBy("term").agg(F.count("*").alias("df")), n, least)


def _idf(df: DataFrame, n: int, least: int) -> DataFrame:
    return df.filter(F.col("df") >= least).select("term", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")).persist(StorageLevel.MEMORY_AND_DISK)


def similarities(counts: DataFrame, keys: list[str], anchor: DataFrame, idf: DataFrame, sublinear: bool = True) -> DataFrame:
    """(keys, similarity): cosine of each text's vector to the anchor's (term, tf); texts that share no term have 0.

    Only lengths and products are summed; no vector is ever built.  A term
    without idf weighs nothing, so every text keeps its row in one pass.
    """
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    a = anchor.join(idf, "term").select("term", (tf * F.col("idf")).alias("wa"))
    length = a.agg(F.sqrt(F.sum(F.col("wa") * F.col("wa")))).first()[0] or 0.0
    known = idf.join(a, "term", "left").withColumn("wa", F.coalesce("wa", F.lit(0.0)))
    each = counts.join(known, "term", "left").withColumn("w", F.coalesce(tf * F.col("idf"), F.lit(0.0)))
    sums = each.groupBy(*keys).agg(F.sum(F.col("w") * F.coalesce("wa", F.lit(0.0))).alias("_p"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l"))
    score = F.coalesce(F.col("_p") / F.nullif(F.col("_l") * F.lit(float(length)), F.lit(0.0)), F.lit(0.0))
    return sums.select(*keys, score.alias("similarity"))


def variant(counts: DataFrame, anchor: DataFrame, fit: str, score: str, least: int = 2) -> DataFrame:
    """(year, value) of one of the four variants.

    ``counts`` is (doc_id, year, term, tf), or what document_counts gives;
    ``anchor`` is (term, tf); ``fit`` is "year" or "record", what idf is fitted
    on besides the anchor; ``score`` is "year", annual documents, or
    "record_mean", the mean over records.

    Documents are counted as the terms of a year are summed up, so only a
    score of records keeps terms by document.
    """
    if "fresh" not in counts.columns:
        first = lambda *keys, by: (F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) == 1).cast("int")
        counts = counts.withColumn("fresh", first("doc_id", "term", by=["year"])).withColumn("head", first("doc_id", by=["term", "year"]))
    if score != "year":
        counts = counts.persist(StorageLevel.MEMORY_AND_DISK)  # texts are read and cut into words once
    sums = [F.sum(c).alias(c) for c in ("tf", "fresh", "head")]
    annual = counts.groupBy("year", "term").agg(*sums).persist(StorageLevel.MEMORY_AND_DISK)
    anchor = anchor.persist(StorageLevel.MEMORY_AND_DISK)
    units = F.col("fresh") if fit == "record" else F.lit(1).cast("long")
    total = F.sum("head") if fit == "record" else F.count_distinct("year")
    n = (annual.agg(total).first()[0] or 0) + int(not anchor.isEmpty())
    df = annual.select("term", units.alias("df")).union(anchor.select("term", F.lit(1).cast("long"))).groupBy("term").agg(F.sum("df").alias("df"))
    idf = _idf(df, n, least)
    if score == "year":
        return similarities(annual.select("year", "term", "tf"), ["year"], anchor, idf).select("year", F.col("similarity").alias("value"))
    each = similarities(counts, ["doc_id", "year"], anchor, idf)
    return each.groupBy("year").agg(F.avg("similarity").alias("value"))


def pair_scores(texts: DataFrame, anchor: str, key: str = "direction", stop: list[str] | None = None) -> DataFrame:
    """(key, similarity) of a few texts to an anchor text, idf fitted on all of them, plain term counts."""
    spark = texts.sparkSession
    a = term_counts(spark.createDataFrame([("_anchor", anchor)], [key, "text"]), [key], stop=stop)
    counts = term_counts(texts, [key], stop=stop)
    idf = inverse_frequencies(counts.union(a), [key], 1)
    return similarities(counts, [key], a.select("term", "tf"), idf, sublinear=False)


def pair_delta(scores: DataFrame, keys: list[str], value: str, plus: str = "concordant", minus: str = "discordant", direction: str = "direction") -> DataFrame:
    """(keys, delta): the value of one direction less the other's."""
    at = lambda d: F.max(F.when(F.col(direction) == d, F.col(value)))
    return scores.groupBy(*keys).agg((at(plus) - at(minus)).alias("delta"))
