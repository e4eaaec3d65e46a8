"""Queries over words: TF-IDF variants, token positions, occurrence caps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import text as X
from halyard.operators import lexical as L
from halyard.operators import resample as B
from halyard.operators.trend import trend
from halyard.plans import model as M
from halyard.plans.corpus_queries import rounded
from halyard.plans.model import r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The document that is the lexical anchor.
ANCHOR = 1


def _counts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Terms of English documents by year, and of the anchor."""
    d = M.read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", M.year_of(F.col("source")).alias("year"), "text")
    counts = L.document_counts(d)
    return counts, counts.filter(F.col("doc_id") == ANCHOR).select("term", "tf")


def _sql(fit: str, score: str) -> str:
    unit = "year" if fit == "year" else "doc_id"
    keys = "year" if score == "year" else "doc_id, year"
    return f"""WITH k AS (
  SELECT doc_id, (2000 + substr(source, 4)::INT)::INT AS year, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE lang = 'en'
), c AS (SELECT doc_id, year, term, count(*) AS tf FROM k GROUP BY ALL), a AS (SELECT term, tf FROM c WHERE doc_id = {ANCHOR}
), u AS (SELECT DISTINCT {unit}::BIGINT AS u, term FROM c UNION ALL SELECT -1, term FROM a
), n AS (SELECT count(DISTINCT u) AS n FROM u), i AS (SELECT term, ln((1.0 + (SELECT n FROM n)) / (1 + count(*))) + 1 AS idf FROM u GROUP BY term HAVING count(*) >= 2
), w AS (SELECT {keys}, term, (1 + ln(sum(tf))) * any_value(idf) AS w FROM c JOIN i USING (term) GROUP BY {keys}, term
), aw AS (SELECT term, (1 + ln(tf)) * idf AS wa FROM a JOIN i USING (term)), al AS (SELECT sqrt(sum(wa * wa)) AS l FROM aw
), s AS (SELECT {keys}, coalesce(sum(w * wa), 0) / (sqrt(sum(w * w)) * (SELECT l FROM al)) AS s FROM w LEFT JOIN aw USING (term) GROUP BY {keys}
), z AS (SELECT DISTINCT {keys} FROM c), f AS (SELECT z.year, coalesce(s, 0) AS s FROM z LEFT JOIN s USING ({keys}))
SELECT year, {r('avg(s)', 'value', 8)} FROM f GROUP BY year"""


def _variant(fit: str, score: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        counts, anchor = _counts(spark, sf_dir)
        return rounded(L.variant(counts, anchor, fit, score), "value", places=8)

    return run


for _name, _fit, _score in (("tfidf_year_year", "year", "year"), ("tfidf_year_record", "year", "record_mean"), ("tfidf_record_year", "record", "year"), ("tfidf_record_record", "record", "record_mean")):
    QUERIES[_name] = _variant(_fit, _score)
    ORACLE[_name] = _sql(_fit, _score)


def tfidf_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tau of annual documents' similarity to the anchor."""
    counts, anchor = _counts(spark, sf_dir)
    t = trend(L.variant(counts, anchor, "year", "year"), [], y="value")
    return rounded(t, "tau", "slope")


QUERIES["tfidf_trend"] = tfidf_trend
ORACLE["tfidf_trend"] = "WITH q AS (" + _sql("year", "year").replace("round(avg(s), 8) + 0.0 AS value", "avg(s) AS value") + f"), t AS ({M.trend_sql('q', [], y='value')}) SELECT n_points, {r('tau', 'tau')}, {r('slope', 'slope')} FROM t"

#: Sentences whose words, but not whose order, agree.
PAIRS = {"concordant": "rest was superior to surgery for old patients", "discordant": "surgery was superior to rest for old patients", "other": "rest helps"}
CLAIM = "old patients should rest without surgery"


def tfidf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reversed claims have one bag of words, so one score: their difference is 0."""
    texts = spark.createDataFrame(list(PAIRS.items()), "direction string, text string")
    scores = L.pair_scores(texts, CLAIM).withColumn("case", F.lit("claim"))
    delta = L.pair_delta(scores, ["case"], "similarity")
    return rounded(scores.join(delta, "case").select("direction", "similarity", "delta"), "similarity", "delta")


_LITERALS = ", ".join(f"('{k}', '{v}')" for k, v in PAIRS.items())
QUERIES["tfidf_pairs"] = tfidf_pairs
ORACLE["tfidf_pairs"] = f"""WITH t(d, x) AS (VALUES {_LITERALS}, ('_a', '{CLAIM}')), k AS (SELECT d, unnest(regexp_extract_all(lower(x), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM t
), c AS (SELECT d, term, count(*) AS tf FROM k GROUP BY ALL), i AS (SELECT term, ln(5.0 / (1 + count(*))) + 1 AS idf FROM c GROUP BY term
), w AS (SELECT d, term, tf * idf AS w FROM c JOIN i USING (term)), s AS (
  SELECT b.d, coalesce((SELECT sum(x.w * y.w) FROM w x JOIN w y USING (term) WHERE x.d = b.d AND y.d = '_a'), 0)
    / (SELECT sqrt(sum(w * w)) FROM w WHERE d = b.d) / (SELECT sqrt(sum(w * w)) FROM w WHERE d = '_a') AS s FROM (SELECT DISTINCT d FROM c WHERE d <> '_a') b)
SELECT d AS direction, {r('s', 'similarity')}, {r("(SELECT s FROM s WHERE d = 'concordant') - (SELECT s FROM s WHERE d = 'discordant')", 'delta')} FROM s"""

PART = ["of", "the"]


def ngram_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two tokens stand next to each other."""
    # A generated column is computed once, however often it is used.
    at = F.explode(F.array(X.positions(X.tokens(F.col("text")), PART))).alias("at")
    d = M.read(spark, sf_dir, "documents").select("doc_id", at).filter("size(at) > 0")
    return d.select("doc_id", F.size("at").cast("long").alias("n"), F.array_join(F.transform("at", lambda i: i.cast("string")), ",").alias("positions"))


_HITS = """k AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS t FROM documents
), p AS (SELECT doc_id, [i FOR i IN range(0, len(t) - 1) IF t[i + 1] = 'of' AND t[i + 2] = 'the'] AS ix FROM k)"""
QUERIES["ngram_positions"] = ngram_positions
ORACLE["ngram_positions"] = f"WITH {_HITS} SELECT doc_id, len(ix)::BIGINT AS n, array_to_string(ix, ',') AS positions FROM p WHERE len(ix) > 0"


def occurrence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two occurrences a document, until the document that reaches the cap."""
    hits = ngram_positions(spark, sf_dir).select("doc_id", F.col("n").alias("hits"))
    return B.capped_occurrences(hits, [B.draw(F.col("doc_id"), F.lit(0)), "doc_id"], total=200)


QUERIES["occurrence_cap"] = occurrence_cap
ORACLE["occurrence_cap"] = f"""WITH {_HITS}, h AS (SELECT doc_id, least(len(ix), 2)::BIGINT AS kept, ('0x' || substr(md5(doc_id::VARCHAR || '-0'), 1, 8))::BIGINT AS o FROM p WHERE len(ix) > 0
), b AS (SELECT doc_id, kept, coalesce(sum(kept) OVER (ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT doc_id, kept FROM b WHERE before < 200"""
