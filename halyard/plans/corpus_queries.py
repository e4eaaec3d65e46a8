"""Queries over the corpus: selection, scores, series, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import series as S
from halyard.functions import text as X
from halyard.functions import vectors as V
from halyard.operators import annual as A
from halyard.operators import corpus as C
from halyard.operators import encode as E
from halyard.operators import report as R
from halyard.plans import model as M
from halyard.plans.model import SQL as CTE
from halyard.plans.model import r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: S.rounded(F.col(n), places) for n in names})


_TEXT = "trim(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', ''))"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the first line is the title, the rest the abstract."""
    d = M.read(spark, sf_dir, "documents")
    labels = M.read(spark, sf_dir, "labels").select("doc_id", "toxic")
    cut = F.locate("\n", F.col("text"))
    title = F.when(cut > 0, F.substring("text", F.lit(1), cut - 1)).otherwise(F.col("text"))
    abstract = F.when(cut > 0, F.substring("text", cut + 1, F.length("text"))).otherwise(F.lit(""))
    types = F.when(F.col("toxic") == 1, F.array(F.lit("Editorial"))).otherwise(F.array().cast("array<string>"))
    return d.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("pmid"), title.alias("title"), abstract.alias("abstract"), F.substring("source", 4, 10).alias("year"), F.array("lang").alias("languages"), types.alias("publication_types"))


_RECORDS = """records AS (
  SELECT doc_id, lang, source, coalesce(toxic = 1, false) AS excluded,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, 1, position(chr(10) IN text) - 1) ELSE text END AS title,
    CASE WHEN position(chr(10) IN text) > 0 THEN substr(text, position(chr(10) IN text) + 1) ELSE '' END AS abstract
  FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id)
), stripped AS (
  SELECT *, regexp_replace(regexp_replace(title, '^\\s+', ''), '\\s+$', '') AS t, regexp_replace(regexp_replace(abstract, '^\\s+', ''), '\\s+$', '') AS b FROM records
)"""


@query(f"""WITH {_RECORDS}
SELECT doc_id::VARCHAR AS pmid, substr(source, 4)::INT AS year, sha256(concat_ws(' ', nullif(t, ''), nullif(b, ''))) AS text_sha256
FROM stripped WHERE lang IN ('en', 'eng', 'english') AND NOT excluded AND concat_ws(' ', nullif(t, ''), nullif(b, '')) <> ''""")
def select_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = C.select_records(_records(spark, sf_dir), ["editorial"])
    return kept.select("pmid", "year", F.sha2("text", 256).alias("text_sha256"))


@query(f"""WITH {_RECORDS}
SELECT doc_id, sha256(concat_ws(' ', nullif(t, ''), nullif(b, ''))) AS joined_sha256,
  sha256(regexp_replace(regexp_replace(title || '. ' || abstract, '^\\s+', ''), '\\s+$', '')) AS dotted_sha256, sha256(title || ' ' || abstract) AS raw_sha256
FROM stripped""")
def text_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, a = F.col("title"), F.col("abstract")
    forms = {"joined_sha256": X.record_text(t, a), "dotted_sha256": X.dotted_text(t, a), "raw_sha256": X.raw_text(t, a)}
    return _records(spark, sf_dir).select(F.col("pmid").cast("long").alias("doc_id"), *[F.sha2(c, 256).alias(n) for n, c in forms.items()])


@query("SELECT doc_id, substr(source, 4)::INT AS strict_year, TRY_CAST(source AS INT) AS lenient_year, 1::INT AS n_types FROM documents")
def coerced_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.read(spark, sf_dir, "documents")
    listed = F.concat(F.lit("['"), F.col("lang"), F.lit("']"))
    return d.select("doc_id", X.strict_year(F.substring("source", 4, 10)).alias("strict_year"), X.lenient_year(F.col("source")).alias("lenient_year"), F.size(X.parse_types(listed)).alias("n_types"))


@query("""WITH j AS (
  SELECT d.doc_id, d.lang = 'en' AS english, coalesce(l.toxic = 1, false) AS excluded, e.vec_id IS NOT NULL AS vec, position(chr(10) IN d.text) = 0 AS title_only, (2000 + substr(d.source, 4)::INT)::INT AS year
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id
), k AS (SELECT *, english AND NOT excluded AND vec AS embedded, year BETWEEN 2000 AND 2024 AS in_window FROM j
), f AS (SELECT *, embedded AND in_window AND count(*) FILTER (embedded AND in_window) OVER (PARTITION BY year) >= 5 AS analyzed FROM k)
SELECT count(*) AS raw, count_if(excluded)::BIGINT AS excluded, count_if(embedded)::BIGINT AS embedded, count_if(embedded AND title_only)::BIGINT AS title_only,
  count_if(embedded AND NOT in_window)::BIGINT AS outside_window, count_if(embedded AND in_window AND NOT analyzed)::BIGINT AS below_floor,
  count_if(analyzed)::BIGINT AS analyzed, count(DISTINCT CASE WHEN analyzed THEN year END) AS years FROM f""")
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.typed(spark, sf_dir, M.read(spark, sf_dir, "documents"))
    e = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("vec"))
    rows = d.join(e, "doc_id", "left").withColumn("year", M.year_of(F.col("source")))
    rows = rows.withColumn("embedded", (F.col("lang") == "en") & ~F.col("excluded") & F.coalesce("vec", F.lit(False)))
    rows = rows.withColumn("in_window", C.in_window(F.col("year"))).withColumn("title_only", F.locate("\n", F.col("text")) == 0).drop("text")
    counts = rows.filter("embedded and in_window").groupBy("year").agg((F.count("*") >= 5).alias("enough"))
    rows = rows.join(counts, "year", "left").withColumn("analyzed", F.col("embedded") & F.col("in_window") & F.coalesce("enough", F.lit(False)))
    return C.funnel(rows, [])


@query(f"""WITH {CTE}, c AS (SELECT doc_id, year, count(*) OVER (PARTITION BY year) AS n FROM corpus)
SELECT doc_id, year, (year BETWEEN 2000 AND 2024 AND n >= 5)::INT AS analyzed FROM c""")
def year_floor_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.floor_mask(M.corpus(spark, sf_dir).select("doc_id", "year"), [])


@query("SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents")
def raw_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.with_ordinal(M.read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


@query("""WITH m AS (SELECT embedding, vec_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([x * x FOR x IN CAST(embedding AS DOUBLE[])])) AS n FROM embeddings)
SELECT vec_id, round(n, 6) + 0.0 AS norm, round(v[1] / (n + 1e-9), 6) + 0.0 AS shifted, round(v[1] / greatest(n, 1e-9), 6) + 0.0 AS clipped, round(v[1] / n, 6) + 0.0 AS strict FROM m""")
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    first = lambda x: S.rounded(F.get(x, F.lit(0)))
    return M.read(spark, sf_dir, "embeddings").select("vec_id", S.rounded(V.norm(v)).alias("norm"), first(V.unit_shifted(v)).alias("shifted"), first(V.unit_clipped(v)).alias("clipped"), first(V.unit(v)).alias("strict"))


@query(f"WITH {CTE} SELECT doc_id, year, {', '.join(r(f'max(cos) FILTER (anchor = {i})', f'cos{i}') for i in M.ANCHORS)} FROM scored GROUP BY doc_id, year")
def cosine_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = M.corpus(spark, sf_dir)
    return c.select("doc_id", "year", *[S.rounded(V.cosine(F.col("embedding"), F.lit(M.anchor(spark, sf_dir, i)))).alias(f"cos{i}") for i in M.ANCHORS])


@query(f"WITH {CTE} SELECT year, n, {r('mean', 'mean')}, {r('se', 'standard_error')} FROM annual WHERE anchor = 0")
def annual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(A.annual_series(M.scored(spark, sf_dir), []), "mean", "standard_error")


@query(f"""WITH {CTE}
SELECT year, count(*) AS n, {r('sum(weight)', 'weight_sum')}, {r('avg(cos)', 'mean')}, {r('sum(cos * weight) / sum(weight)', 'weighted_mean')}
FROM typed WHERE anchor = 0 AND year BETWEEN 2000 AND 2024 GROUP BY year HAVING count(*) >= 5""")
def annual_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.typed(spark, sf_dir, M.scored(spark, sf_dir))
    return rounded(A.weighted_series(rows, []), "weight_sum", "mean", "weighted_mean")


@query(f"""WITH {CTE}
SELECT year, count(*) AS n, count_if(weight > 1)::BIGINT AS high, {r('100.0 * count_if(weight > 1) / count(*)', 'high_pct')}
FROM typed WHERE anchor = 0 GROUP BY year HAVING count(*) >= 5""")
def evidence_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.typed(spark, sf_dir, M.corpus(spark, sf_dir).select("doc_id", "year")).withColumn("is_high", F.array_contains("types", "high"))
    return A.volumes(rows, [], "is_high").filter("n >= 5").withColumn("high_pct", S.rounded(100.0 * F.col("high") / F.col("n")))


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS weight, quality = 1 AS high FROM labels")
def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = F.when(F.col("quality") == 1, F.array(F.lit("Randomized Controlled Trial, Phase II"), F.lit("rct"))).otherwise(F.array(F.lit("Case Reports")))
    rows = M.read(spark, sf_dir, "labels").withColumn("types", types)
    return rows.select("doc_id", X.evidence_weight(F.col("types"), {"rct": 3.0, "Case Reports": 0.5}).alias("weight"), X.high_evidence(F.col("types")).alias("high"))


_CENTROID = f"""WITH {CTE}, u AS (
  SELECT year, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS u FROM corpus
), e AS (SELECT year, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS j FROM u
), m AS (SELECT year, j, avg(x) AS x, count(*) AS n FROM e GROUP BY year, j
), c AS (SELECT year, max(n) AS n, list(x ORDER BY j) AS c FROM m GROUP BY year HAVING max(n) >= 5
), d AS (
  SELECT year, n, sqrt(list_sum([x * x FOR x IN c])) AS len, list_inner_product(c, a) / sqrt(list_sum([x * x FOR x IN a])) AS s
  FROM c, anchors WHERE anchor = 0
)"""


@query(_CENTROID + f" SELECT year, n, {r('s', 'mean_cosine')}, {r('len', 'centroid_norm')}, {r('s / len', 'centroid_anchor_cosine')} FROM d")
def centroid_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.decomposition(M.corpus(spark, sf_dir), ["year"], M.anchor(spark, sf_dir, 0))
    return rounded(d, "mean_cosine", "centroid_norm", "centroid_anchor_cosine")


@query("""SELECT count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL) AS matched, count(*) FILTER (e.vec_id IS NULL) AS left_only,
  count(*) FILTER (d.doc_id IS NULL) AS right_only, count(*) FILTER (d.doc_id IS NOT NULL AND e.vec_id IS NOT NULL AND d.k <> e.label) AS other_label
FROM (SELECT doc_id, doc_id % 10 AS k FROM documents) d FULL JOIN embeddings e ON d.doc_id = e.vec_id""")
def alignment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 10).alias("k"))
    e = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"))
    return C.alignment(d, e, "id", {"other_label": ("k", "label")})


@query("""SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings)) AS documents_only,
  (SELECT count(*) FROM (SELECT vec_id FROM embeddings EXCEPT SELECT doc_id FROM documents)) AS embeddings_only,
  (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) AS labels_only""")
def key_set_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = {n: M.read(spark, sf_dir, n).select(F.col(k).alias("id")) for n, k in (("documents", "doc_id"), ("embeddings", "vec_id"), ("labels", "doc_id"))}
    flag = lambda n: keys[n].distinct().withColumn(n, F.lit(1))
    both = flag("documents").join(flag("embeddings"), "id", "full_outer").join(flag("labels"), "id", "full_outer")
    has = lambda n: F.col(n).isNotNull()
    return both.agg(F.count_if(has("documents") & ~has("embeddings")).alias("documents_only"), F.count_if(has("embeddings") & ~has("documents")).alias("embeddings_only"), F.count_if(has("labels") & ~has("documents")).alias("labels_only"))


@query(f"""WITH {CTE}
SELECT count(*)::BIGINT AS n_bins, sum(n)::BIGINT AS total, min(n) AS least, median(n)::DOUBLE AS middle, max(n) AS most, min(year) AS first_x, max(year) AS last_x,
  arg_min(n, year) AS first_n, arg_max(n, year) AS last_n FROM annual WHERE anchor = 0""")
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.series_summary(A.annual_series(M.scored(spark, sf_dir), []), []).withColumn("middle", F.col("middle").cast("double"))


@query(f"""WITH {CTE}, a AS (SELECT year, n::DOUBLE AS n, mean FROM annual WHERE anchor = 0), t AS ({M.trend_sql('a', [])})
SELECT 'all' AS "case", 'annual.' || year || '.' || m AS metric, round(v, 6) + 0.0 AS value, 'annual:' || m AS source
FROM (SELECT year, 'n' AS m, n AS v FROM a UNION ALL SELECT year, 'mean', mean FROM a)
UNION ALL SELECT 'all', 'trend.' || m, round(v, 6) + 0.0, 'trend:' || m
FROM (SELECT 'n_points' AS m, n_points::DOUBLE AS v FROM t UNION ALL SELECT 'tau', tau FROM t UNION ALL SELECT 'slope', slope FROM t)""")
def numeric_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.operators.trend import trend

    a = A.annual_series(M.scored(spark, sf_dir), []).withColumn("case", F.lit("all")).drop("standard_error")
    out = R.numeric_index({"annual": (a, ["case", "year"]), "trend": (trend(a, ["case"]), ["case"])})
    return rounded(out, "value")


@query("""SELECT count(*)::BIGINT AS matched, 0::BIGINT AS old_only, 0::BIGINT AS new_only,
  round(max(list_max([abs(x - x * 1.5) FOR x IN CAST(embedding AS DOUBLE[])])), 6) + 0.0 AS max_abs_diff FROM embeddings""")
def row_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = M.read(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return rounded(R.row_diff(e, e.withColumn("v", F.transform("v", lambda x: x * 1.5)), "vec_id", "v"), "max_abs_diff")


@query("""WITH e AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings
), m AS (SELECT label, j, avg(x) AS x FROM e GROUP BY label, j
), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label)
SELECT label, (j - 1)::INT AS position, round(x / greatest(n, 1e-9), 6) + 0.0 AS value FROM m JOIN n USING (label)""")
def pooling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.pool_mean(M.read(spark, sf_dir, "embeddings"), ["label"])
    return rounded(p.select("label", F.posexplode("pooled").alias("position", "value")), "value")


@query("""WITH f AS (SELECT label, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS v FROM embeddings GROUP BY label
), u AS (SELECT label, v, sqrt(list_sum([x * x FOR x IN v])) AS n FROM f)
SELECT label, (unnest(range(1, len(v) + 1)) - 1)::INT AS position, round(unnest(v) / greatest(n, 1e-9), 6) + 0.0 AS value FROM u""")
def pooling_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = E.pool_first(M.read(spark, sf_dir, "embeddings"), ["label"], "vec_id")
    return rounded(p.select("label", F.posexplode("pooled").alias("position", "value")), "value")


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'),
  '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from halyard.sources.articles import strip_markup

    return M.read(spark, sf_dir, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))


_CONTRIBUTIONS = """r AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings
), a AS (SELECT [x / sqrt(list_sum([y * y FOR y IN CAST(embedding AS DOUBLE[])])) FOR x IN CAST(embedding AS DOUBLE[])] AS a FROM embeddings WHERE vec_id = 0
), e AS (SELECT label, k, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS j FROM r
), s AS (SELECT label, j, sum(x) AS x, sum(CASE WHEN k <= 2 THEN x ELSE 0 END) AS p FROM e GROUP BY label, j
), n AS (SELECT label, sqrt(sum(x * x)) AS n, sum(x * a[j]) AS x, sum(p * a[j]) AS p FROM s, a GROUP BY label)"""


@query(f"WITH {_CONTRIBUTIONS} SELECT label, {r('p / n', 'part')}, {r('x / n', 'cosine')} FROM n")
def term_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector of a label as a token state: the share of the label's cosine that its first two carry."""
    e = M.read(spark, sf_dir, "embeddings")
    a = V.unit(F.lit(M.anchor(spark, sf_dir, 0)))
    return rounded(E.contributions(e, ["label"], "vec_id", 2, a), "part", "cosine")


@query(f"WITH {_CONTRIBUTIONS} SELECT count(*) AS n, {r('avg(p / n)', 'part')}, {r('avg(x / n)', 'cosine')} FROM n")
def mean_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over labels of what the first two states carry."""
    e = M.read(spark, sf_dir, "embeddings")
    each = E.contributions(e, ["label"], "vec_id", 2, V.unit(F.lit(M.anchor(spark, sf_dir, 0))))
    return rounded(each.agg(F.count("*").alias("n"), F.avg("part").alias("part"), F.avg("cosine").alias("cosine")), "part", "cosine")


@query(f"""WITH k AS (SELECT (2000 + substr(source, 4)::INT)::INT AS year, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents WHERE lang = 'en')
SELECT year, term, count(*) AS n FROM k GROUP BY year, term HAVING count(*) >= 10""")
def frequent_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a year that occur ten times."""
    d = M.read(spark, sf_dir, "documents").filter("lang = 'en'")
    return C.at_least(d.select(M.year_of(F.col("source")).alias("year"), F.explode(X.tokens(F.col("text"))).alias("term")), ["year", "term"], 10)


@query(f"""WITH {CTE}, h AS (SELECT year, list_cosine_similarity(v[1:32], (SELECT a[1:32] FROM anchors WHERE anchor = 0)) AS cos FROM corpus
), s AS (SELECT year, avg(cos) AS mean FROM h WHERE year BETWEEN 2000 AND 2024 GROUP BY year HAVING count(*) >= 5), t AS ({M.trend_sql('s', [])})
SELECT n_points, {r('tau', 'tau')}, {r('slope', 'slope', 9)} FROM t""")
def other_vector_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend over another vector of the same records: the first half stands in for the first token's state."""
    from halyard.operators.trend import trend

    half = F.slice(F.col("embedding"), 1, 32)
    cos = V.cosine(half, F.lit(M.anchor(spark, sf_dir, 0)[:32]))
    t = trend(A.annual_series(M.corpus(spark, sf_dir).select("year", cos.alias("cos")), []), [])
    return rounded(rounded(t, "tau"), "slope", places=9)


@query("""WITH s AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS ordinal, substr(text, 1, 5) AS spec FROM benchmark
), q AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents) SELECT ordinal, item_id, doc_id, spec FROM s JOIN q USING (ordinal)""")
def ordered_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifications with the records at the same place."""
    specs = M.read(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, 5).alias("spec"))
    records = M.read(spark, sf_dir, "documents").select("doc_id")
    return R.ordered_zip(specs, ["item_id"], records, ["doc_id"])


@query("""SELECT count(*) AS members, count(DISTINCT e.vec_id) AS records, count(*) FILTER (d.doc_id IS NULL) AS without_record,
  count(*) FILTER (abs(cos) > 1 + 1e-5)::BIGINT AS out_of_range, count(*) FILTER (d.text IS NULL OR sha256(d.text) <> sha256(d.text || ''))::BIGINT AS other_text
FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS cos FROM embeddings) e LEFT JOIN documents d ON d.doc_id = e.vec_id""")
def membership_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against the records that they are of: members, records, and what does not hold."""
    cos = V.cosine(F.col("embedding"), F.lit(M.anchor(spark, sf_dir, 0)))
    scores = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), cos.alias("cos"))
    records = M.read(spark, sf_dir, "documents").select("doc_id", "text")
    told = scores.join(records.select("doc_id", F.sha2("text", 256).alias("text_sha256")), "doc_id", "left")
    return R.score_audit(told, records, "doc_id", ["cos"])


#: Words of the synthetic prose, common ones and others.
TERMS = ["the", "of the", "erly", "tion"]


@query()
def term_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far context moves terms, by a stand-in encoder; terms with ten occurrences."""
    d = M.read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "text")
    context = E.context_vectors(d, TERMS, E.neighbour_encoder, ["doc_id"])
    terms = spark.createDataFrame([(t, t) for t in TERMS], "term string, text string")
    alone = E.occurrence_vectors(terms, TERMS, E.neighbour_encoder).select(F.col("term").alias("_t"), F.inline("found")).filter("term = _t")
    anchor = E.neighbour_encoder()(["the claim that stands"])[0][1].mean(axis=0).tolist()
    moved = E.displacement(alone.select("term", F.get("vectors", F.lit(0)).alias("vector")), context, anchor)
    return rounded(moved, "displacement", "cos_alone", "cos_context", "pull")


_DAY = "(SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, avg(value) AS mean FROM events GROUP BY 1, 2)"


@query(f"""SELECT event_type, day::INT AS day, printf('%.3f', round(mean, 3)) AS f3, printf('%.6f', round(mean, 6)) AS f6, printf('%.8f', round(mean, 8)) AS f8 FROM {_DAY}""")
def metric_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means with three, six and eight places."""
    e = M.read(spark, sf_dir, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "value")
    m = e.groupBy("event_type", "day").agg(F.avg("value").alias("mean"))
    return m.select("event_type", "day", *[S.fixed(F.col("mean"), k).alias(f"f{k}") for k in (3, 6, 8)])
