"""Queries for trends, robustness and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.functions import pvalues as P
from halyard.functions import series as S
from halyard.functions import vectors as V
from halyard.operators import annual as A
from halyard.operators import geometry as G
from halyard.operators import resample as B
from halyard.operators import retrieval as Q
from halyard.operators import trend as T
from halyard.plans import model as M
from halyard.plans.corpus_queries import _CENTROID, rounded
from halyard.plans.model import SQL as CTE
from halyard.plans.model import r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
#: Replicates of the shuffle, of the bootstrap and of the phase null.
SHUFFLES, BOOTSTRAPS, PHASES = 1000, 1500, 5000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _annual(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> DataFrame:
    return A.annual_series(M.scored(spark, sf_dir, vec_id), [])


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, day, n, mean): day counts from the first of 2024."""
    e = M.read(spark, sf_dir, "events").select("event_type", F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).alias("day"), "value")
    return e.groupBy("event_type", "day").agg(F.count("*").cast("long").alias("n"), F.avg("value").alias("mean"))


def _yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = M.read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"), "o_totalprice")
    return o.groupBy("priority", "year").agg(F.count("*").cast("long").alias("n"), F.avg("o_totalprice").alias("mean"))


_DAILY = "daily AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS day, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1, 2)"
_YEARLY = "yearly AS (SELECT o_orderpriority AS priority, year(o_orderdate)::INT AS year, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2)"
_A0 = "a0 AS (SELECT year, n, mean FROM annual WHERE anchor = 0)"


@query(f"WITH {CTE}, {_A0}, t AS ({M.trend_sql('a0', [])}) SELECT n_points, (SELECT sum(n) FROM a0)::BIGINT AS n, {r('tau', 'tau')}, {r('slope * 1e4', 'slope_e4')} FROM t")
def trend_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, join, cosine, annual means, tau and slope."""
    g = _annual(spark, sf_dir).agg(S.series(F.col("year"), F.col("mean")).alias("p"), F.sum("n").cast("long").alias("n")).filter(F.size("p") >= 2)
    return g.select(F.size("p").cast("long").alias("n_points"), "n", S.rounded(S.kendall(F.col("p"))).alias("tau"), S.rounded(S.theil_sen(F.col("p")) * 1e4).alias("slope_e4"))


@query(f"""WITH {CTE}, w AS (SELECT year, sum(cos * weight) / sum(weight) AS mean FROM typed WHERE anchor = 0 AND year BETWEEN 2000 AND 2024 GROUP BY year HAVING count(*) >= 5
), t AS ({M.trend_sql('w', [])}) SELECT n_points, {r('tau', 'tau')}, {r('slope', 'slope', 9)} FROM t""")
def trend_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.typed(spark, sf_dir, M.scored(spark, sf_dir))
    t = T.trend(A.weighted_series(rows, []), [], y="weighted_mean")
    return rounded(rounded(t, "tau"), "slope", places=9)


@query(f"WITH {CTE}, a AS (SELECT anchor, year, mean FROM annual WHERE anchor < 3), t AS ({M.trend_sql('a', ['anchor'])}) SELECT anchor::INT AS anchor, n_points, {r('tau', 'tau')}, {r('slope', 'slope', 9)} FROM t")
def cross_anchor_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(T.trend(_cross(spark, sf_dir), ["anchor"]), "tau"), "slope", places=9)


def _cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor, year, n, mean): all anchors in one pass over the corpus."""
    each = F.array(*[F.struct(F.lit(i).alias("anchor"), V.cosine(F.col("embedding"), F.lit(M.anchor(spark, sf_dir, i))).alias("cos")) for i in M.ANCHORS])
    long = M.corpus(spark, sf_dir).select("year", F.explode(each).alias("s")).select("year", "s.*")
    return A.annual_series(long, ["anchor"])


@query(f"WITH {CTE} SELECT anchor::INT AS anchor, year, n, {r('mean', 'mean')} FROM annual WHERE anchor < 3")
def cross_anchor_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_cross(spark, sf_dir).drop("standard_error"), "mean")


@query(f"WITH {CTE}, a AS (SELECT year, mean FROM annual WHERE anchor = 3), t AS ({M.trend_sql('a', [])}) SELECT n_points, {r('tau', 'tau')}, {r('slope', 'slope', 9)} FROM t")
def legacy_anchor_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(T.trend(_annual(spark, sf_dir, M.OTHER_ANCHOR), []), "tau"), "slope", places=9)


@query(_CENTROID + f", z AS (SELECT year, len AS mean FROM d), t AS ({M.trend_sql('z', [])}), z2 AS (SELECT year, s / len AS mean FROM d), t2 AS ({M.trend_sql('z2', [])}) SELECT t.n_points, {r('t.tau', 'norm_tau')}, {r('t2.tau', 'angle_tau')} FROM t, t2")
def centroid_norm_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.decomposition(M.corpus(spark, sf_dir), ["year"], M.anchor(spark, sf_dir, 0))
    g = T.gather(d, [], norm="centroid_norm", angle="centroid_anchor_cosine").filter(F.size("norm") >= 2)
    return g.select(F.size("norm").cast("long").alias("n_points"), S.rounded(S.kendall(F.col("norm"))).alias("norm_tau"), S.rounded(S.kendall(F.col("angle"))).alias("angle_tau"))


@query(f"WITH {CTE}, v AS (SELECT year, n AS mean FROM annual WHERE anchor = 0), t AS ({M.trend_sql('v', [])}) SELECT n_points, {r('tau', 'tau')} FROM t")
def publication_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.trend(_annual(spark, sf_dir), [], y="n"), "tau").select("n_points", "tau")


@query(f"WITH {_DAILY}, t AS ({M.trend_sql('daily', ['event_type'], 'day')}) SELECT event_type, n_points, {r('tau', 'tau')}, {r('slope', 'slope')} FROM t")
def event_daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.trend(_daily(spark, sf_dir), ["event_type"], x="day"), "tau", "slope")


@query(f"WITH {_YEARLY}, t AS ({M.trend_sql('yearly', ['priority'])}) SELECT priority, n_points, {r('tau', 'tau')}, {r('slope', 'slope', 4)} FROM t")
def orders_yearly_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(T.trend(_yearly(spark, sf_dir), ["priority"]), "tau"), "slope", places=4)


@query(f"""WITH {CTE}, c AS (SELECT year, count(*) AS n, avg(cos) AS mean FROM scored WHERE anchor = 0 AND year BETWEEN 2000 AND 2024 GROUP BY year
), f AS (SELECT unnest([5, 15, 16, 60]) AS floor), k AS (SELECT f.floor, c.* FROM f JOIN c ON c.n >= f.floor
), z AS (SELECT floor, count(*) AS n_points FROM k GROUP BY floor), t AS ({M.trend_sql('k', ['floor'])}), u AS (
  SELECT f.floor::INT AS floor, coalesce(z.n_points, 0)::BIGINT AS n_points, CASE WHEN z.n_points >= 4 THEN t.tau END AS tau FROM f LEFT JOIN z USING (floor) LEFT JOIN t USING (floor))
SELECT floor, n_points, {r('tau', 'tau')}, CASE WHEN tau < -0.1 THEN 'div' WHEN tau > 0.1 THEN 'conv' WHEN tau IS NOT NULL THEN 'flat' END AS direction FROM u""")
def floor_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.floor_sweep(A.annual_series(M.scored(spark, sf_dir), [], floor=1), [], [5, 15, 16, 60]), "tau")


@query(f"""WITH {_DAILY}, d AS (SELECT DISTINCT event_type, day AS gone FROM daily), k AS (SELECT d.gone, daily.* FROM daily JOIN d ON d.event_type = daily.event_type AND d.gone <> daily.day
), t AS ({M.trend_sql('k', ['event_type', 'gone'], 'day')}), w AS ({M.trend_sql('daily', ['event_type'], 'day')})
SELECT w.event_type, w.n_points, {r('w.tau', 'tau')}, {r('min(t.tau)', 'tau_min')}, {r('max(t.tau)', 'tau_max')} FROM w JOIN t USING (event_type) GROUP BY w.event_type, w.n_points, w.tau""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.leave_one_out(_daily(spark, sf_dir), ["event_type"], x="day"), "tau", "tau_min", "tau_max")


def _tau(source: str, x: str, y: str) -> str:
    return f"(SELECT sum(sign(b.{y} - a.{y}) * sign(b.{x} - a.{x})) / nullif(sqrt(sum((a.{x} <> b.{x})::INT) * sum((a.{y} <> b.{y})::INT)), 0) FROM {source} a JOIN {source} b ON a.year < b.year)"


@query(f"""WITH {CTE}, {_A0}, t AS (SELECT {_tau('a0', 'year', 'mean')} AS xy, {_tau('a0', 'year', 'n')} AS xz, {_tau('a0', 'n', 'mean')} AS yz, (SELECT count(*) FROM a0) AS n_points
), p AS (SELECT *, (xy - xz * yz) / nullif(sqrt((1 - xz * xz) * (1 - yz * yz)), 0) AS partial FROM t)
SELECT n_points, {r('xy', 'tau_xy')}, {r('xz', 'tau_xz')}, {r('yz', 'tau_yz')}, {r('partial', 'partial')}, CASE WHEN partial < -0.05 THEN 'div' WHEN partial > 0.05 THEN 'conv' ELSE 'flat' END AS direction FROM p""")
def partial_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.partial_kendall(_annual(spark, sf_dir), []), "tau_xy", "tau_xz", "tau_yz", "partial")


@query(f"""WITH {CTE}, {_A0}, z AS (
  SELECT mean AS y, (year - avg(year) OVER ()) / stddev_pop(year) OVER () AS x, (ln(n) - avg(ln(n)) OVER ()) / stddev_pop(ln(n)) OVER () AS v FROM a0
), s AS (SELECT count(*) AS n, sum(x * v) AS xv, sum(x * y) AS xy, sum(v * y) AS vy, sum(x * x) AS xx, sum(v * v) AS vv FROM z)
SELECT n AS n_points, {r('(xy * vv - vy * xv) / (xx * vv - xv * xv)', 'beta_x', 8)}, {r('(vy * xx - xy * xv) / (xx * vv - xv * xv)', 'beta_volume', 8)} FROM s""")
def ols_volume_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.regress_on_volume(_annual(spark, sf_dir), []).select("n_points", "beta_x", "beta_volume"), "beta_x", "beta_volume", places=8)


@query(f"""WITH {CTE}, s AS (SELECT year, cos FROM scored WHERE anchor = 0), f AS (SELECT regr_slope(cos, year) AS b, avg(year) AS mx, avg(cos) AS my, count(*) AS n, sum((year - (SELECT avg(year) FROM s)) ** 2) AS sxx FROM s
), g AS (SELECT s.year, sum((s.year - f.mx) * (s.cos - f.my - f.b * (s.year - f.mx))) AS u FROM s, f GROUP BY s.year), m AS (SELECT count(*) AS c, sum(u * u) AS meat FROM g)
SELECT n, c AS clusters, {r('b', 'slope', 8)}, {r('sqrt(c / (c - 1.0) * (n - 1.0) / (n - 2.0) * meat) / sxx', 'standard_error', 8)} FROM f, m""")
def ols_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(T.regress_clustered(M.scored(spark, sf_dir), []).drop("t"), "slope", "standard_error", places=8)


#: How many orders of n things have 0, 1, 2, ... inversions, as lists.
_ORDERS = """orders(n, c) AS (
  SELECT 1, [1.0::DOUBLE] UNION ALL
  SELECT n + 1, [list_sum(c[greatest(k - n, 1) : least(k, len(c))]) FOR k IN range(1, len(c) + n + 1)] FROM orders WHERE n < 33)"""


@query(f"""WITH RECURSIVE {_ORDERS}, {_DAILY}, s AS (
  SELECT a.event_type, ((1 + sqrt(1 + 8 * count(*))) / 2)::BIGINT AS n, count(*) AS whole, sum(sign(b.mean - a.mean))::BIGINT AS s
  FROM daily a JOIN daily b ON a.event_type = b.event_type AND a.day < b.day GROUP BY a.event_type
), f AS (SELECT *, least((whole - s) // 2, whole - (whole - s) // 2) AS few FROM s
), p AS (SELECT event_type, s::DOUBLE / whole AS tau, CASE WHEN 2 * few = whole THEN 1.0 ELSE least(1.0, 2 * list_sum(c[1 : few + 1]) / list_sum(c)) END AS p FROM f JOIN orders ON orders.n = f.n)
SELECT event_type, {r('tau', 'tau')}, {r('p', 'p_value', 9)}, (p < 0.05)::INT AS significant FROM p""")
def kendall_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = T.gather(_daily(spark, sf_dir), ["event_type"], x="day", p="mean")
    out = g.select("event_type", S.rounded(S.kendall(F.col("p"))).alias("tau"), P.kendall_pvalue(F.col("p")).alias("p_value"))
    return rounded(out.withColumn("significant", S.significant(F.col("p_value"))), "p_value", places=9)


@query(f"""WITH {CTE}, {_A0}, z AS (
  SELECT mean AS y, (year - avg(year) OVER ()) / stddev_pop(year) OVER () AS x, (ln(n) - avg(ln(n)) OVER ()) / stddev_pop(ln(n)) OVER () AS v, avg(mean) OVER () AS my FROM a0
), s AS (SELECT count(*) AS n, sum(x * v) AS xv, sum(x * y) AS xy, sum(v * y) AS vy, sum(x * x) AS xx, sum(v * v) AS vv FROM z
), b AS (SELECT *, (xy * vv - vy * xv) / (xx * vv - xv * xv) AS bx, (vy * xx - xy * xv) / (xx * vv - xv * xv) AS bv FROM s
), e AS (SELECT sum((y - my - bx * x - bv * v) ** 2) AS rss FROM z, b
), one AS (SELECT 'volume' AS model, bx / sqrt(rss / (n - 3) * vv / (xx * vv - xv * xv)) AS t, n - 3 AS dof FROM b, e
), c AS (SELECT year, cos FROM scored WHERE anchor = 0
), f AS (SELECT regr_slope(cos, year) AS b, avg(year) AS mx, avg(cos) AS my, count(*) AS n, sum((year - (SELECT avg(year) FROM c)) ** 2) AS sxx FROM c
), g AS (SELECT c.year, sum((c.year - f.mx) * (c.cos - f.my - f.b * (c.year - f.mx))) AS u FROM c, f GROUP BY c.year
), m AS (SELECT count(*) AS k, sum(u * u) AS meat FROM g
), two AS (SELECT 'clustered' AS model, b / (sqrt(k / (k - 1.0) * (n - 1.0) / (n - 2.0) * meat) / sxx) AS t, k - 1 AS dof FROM f, m
), a AS (SELECT *, atan(abs(t) / sqrt(dof)) AS th FROM (SELECT * FROM one UNION ALL SELECT * FROM two)
), q AS (SELECT *, CASE WHEN dof % 2 = 0
  THEN sin(th) * list_sum([exp(lgamma(2 * k + 1) - 2 * lgamma(k + 1) - k * ln(4)) * cos(th) ** (2 * k) FOR k IN range(0, dof // 2)])
  ELSE 2 / pi() * (th + sin(th) * coalesce(list_sum([exp(k * ln(4) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * cos(th) ** (2 * k + 1) FOR k IN range(0, dof // 2)]), 0)) END AS inside FROM a)
SELECT model, {r('t', 't')}, dof::BIGINT AS dof, {r('greatest(0, 1 - inside)', 'p_value', 9)} FROM q""")
def t_pvalue(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.regress_on_volume(_annual(spark, sf_dir), []).select(F.lit("volume").alias("model"), F.col("t_x").alias("t"), "dof")
    c = T.regress_clustered(M.scored(spark, sf_dir), []).select(F.lit("clustered").alias("model"), "t", (F.col("clusters") - 1).alias("dof"))
    both = v.union(c).select("model", "t", F.col("dof").cast("long").alias("dof"))
    return rounded(rounded(both.withColumn("p_value", P.t_pvalue(F.col("t"), F.col("dof"))), "t"), "p_value", places=9)


_PHASE_DRAW = "('0x' || substr(md5(anchor || '-' || k || '-' || rep), 1, 8))::BIGINT * 2 * pi() / 4294967296"


@query(f"""WITH {CTE}, a AS (SELECT anchor, year, mean, row_number() OVER (PARTITION BY anchor ORDER BY year) - 1 AS t, count(*) OVER (PARTITION BY anchor) AS n, avg(mean) OVER (PARTITION BY anchor) AS mid FROM annual WHERE anchor < 3
), k AS (SELECT anchor, n, unnest(range(1, n // 2 + 1)) AS k FROM (SELECT DISTINCT anchor, n FROM a)
), w AS (SELECT anchor, n, k, sqrt(sum(mean * cos(2 * pi() * k * t / n)) ** 2 + sum(mean * sin(2 * pi() * k * t / n)) ** 2) AS w FROM a JOIN k USING (anchor, n) GROUP BY ALL
), f AS (SELECT anchor, n, k, rep, w, CASE WHEN 2 * k = n THEN 0 ELSE {_PHASE_DRAW} END AS phi, CASE WHEN 2 * k = n THEN 1.0 ELSE 2.0 END / n AS scale FROM w, (SELECT unnest(range(1, {PHASES} + 1)) AS rep)
), y AS (SELECT anchor, rep, year, any_value(mid) + sum(w * cos(2 * pi() * k * t / n + phi) * scale) AS mean FROM a JOIN f USING (anchor, n) GROUP BY anchor, rep, year
), t AS ({M.trend_sql('y', ['anchor', 'rep'])}), o AS ({M.trend_sql('a', ['anchor'])})
SELECT o.anchor::INT AS anchor, o.n_points, {r('o.tau', 'tau')}, count_if(abs(t.tau) >= abs(o.tau) - 1e-12)::BIGINT AS exceed, count(*) AS replicates,
  {r('(count_if(abs(t.tau) >= abs(o.tau) - 1e-12) + 1) / (count(*) + 1)', 'p')} FROM o JOIN t USING (anchor) GROUP BY o.anchor, o.n_points, o.tau""")
def phase_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.phase_null(_cross(spark, sf_dir), ["anchor"], replicates=PHASES), "tau", "p")


def _observed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    rows = M.scored(spark, sf_dir).select("doc_id", "year", "cos").filter(F.col("year").between(2000, 2024))
    tau = T.trend(A.annual_series(rows, []), []).first()
    return rows, 0.0 if tau is None or tau["tau"] is None else float(tau["tau"])


_DRAW = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_W = f"{CTE}, {_A0}, w AS (SELECT doc_id, year, cos FROM scored WHERE anchor = 0 AND year BETWEEN 2000 AND 2024), reps AS (SELECT unnest(range(1, {SHUFFLES} + 1)) AS rep), many AS (SELECT unnest(range(1, {BOOTSTRAPS} + 1)) AS rep), obs AS ({M.trend_sql('a0', [])})"


@query(f"""WITH {_W}, v AS (SELECT rep, cos, row_number() OVER (PARTITION BY rep ORDER BY doc_id) AS k FROM w, reps
), y AS (SELECT rep, year, row_number() OVER (PARTITION BY rep ORDER BY {_DRAW.format("doc_id::VARCHAR || '-' || rep")}, doc_id) AS k FROM w, reps
), s AS (SELECT rep, year, avg(cos) AS mean FROM v JOIN y USING (rep, k) GROUP BY rep, year HAVING count(*) >= 5), t AS ({M.trend_sql('s', ['rep'])})
SELECT count(*) AS replicates, count_if(abs(t.tau) >= abs(obs.tau) - 1e-12)::BIGINT AS exceed, {r('(count_if(abs(t.tau) >= abs(obs.tau) - 1e-12) + 1) / (count(*) + 1)', 'p')} FROM t, obs""")
def year_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tau = _observed(spark, sf_dir)
    return rounded(B.year_shuffle(rows, tau, SHUFFLES), "p")


_BOOT = f"""{_W}, i AS (SELECT w.year, cos, row_number() OVER (PARTITION BY w.year ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY w.year) AS n FROM w JOIN a0 USING (year)
), d AS (SELECT rep, year, {_DRAW.format("year::VARCHAR || '-' || k || '-' || rep")} % n + 1 AS k FROM i, many AS reps
), m AS (SELECT rep, year, avg(cos) AS mean FROM d JOIN i USING (year, k) GROUP BY rep, year), t AS ({M.trend_sql('m', ['rep'])}
), mid AS (SELECT rep, median(mean) AS my, median(year) AS mx FROM m GROUP BY rep)"""


def _lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, float]:
    rows, tau = _observed(spark, sf_dir)
    years = A.annual_series(rows, []).select("year")
    return B.bootstrap_lines(B.bootstrap_means(rows.join(years, "year", "left_semi"), BOOTSTRAPS)), tau


@query(f"WITH {_BOOT} SELECT count(*) AS replicates, {r('100.0 * count_if(sign(t.tau) = sign(obs.tau)) / count(*)', 'same_sign_pct')} FROM t, obs")
def bootstrap_same_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, tau = _lines(spark, sf_dir)
    return rounded(B.same_sign(lines, tau), "same_sign_pct")


@query(f"WITH {_BOOT} SELECT {r('quantile_cont(tau, 0.025)', 'tau_low')}, {r('quantile_cont(tau, 0.975)', 'tau_high')} FROM t")
def bootstrap_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.tau_range(_lines(spark, sf_dir)[0]), "tau_low", "tau_high")


@query(f"""WITH {_BOOT}, b AS (SELECT a0.year, mid.my - t.slope * mid.mx + t.slope * a0.year AS v FROM t JOIN mid USING (rep), a0)
SELECT year, {r('quantile_cont(v, 0.025)', 'low')}, {r('quantile_cont(v, 0.975)', 'high')} FROM b GROUP BY year""")
def trend_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(B.trend_band(_lines(spark, sf_dir)[0]), "low", "high")


@query(f"""WITH {CTE}, {_A0}, t AS ({M.trend_sql('a0', [])}), m AS (SELECT median(mean) AS my, median(year) AS mx FROM a0)
SELECT year, n, {r('mean', 'mean')}, {r('se', 'standard_error')}, {r('my - slope * mx + slope * year', 'line')} FROM annual, t, m WHERE anchor = 0""")
def trend_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _annual(spark, sf_dir)
    g = a.agg(F.collect_list(F.struct("year", "n", "mean", "standard_error")).alias("rows"), S.series(F.col("year"), F.col("mean")).alias("p"))
    g = g.withColumn("slope", S.theil_sen(F.col("p"))).withColumn("at", S.intercept(F.col("p"), F.col("slope")))
    out = g.select(F.explode("rows").alias("r"), "slope", "at").select("r.*", (F.col("at") + F.col("slope") * F.col("r.year")).alias("line"))
    return rounded(out, "mean", "standard_error", "line")


@query(f"""WITH d AS (SELECT doc_id, source FROM documents WHERE lang = 'en'), k AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY {_DRAW.format("doc_id::VARCHAR || '-0'")}, doc_id) AS k FROM d) SELECT doc_id, source FROM k WHERE k <= 40""")
def sample_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id", "source")
    return B.sample_per_bin(d, ["source"], 40)


@query(f"""WITH {_DAILY}, w AS (
  SELECT event_type, day, mean, coalesce(lag(mean) OVER o, mean) AS a, coalesce(lead(mean) OVER o, mean) AS b FROM daily WINDOW o AS (PARTITION BY event_type ORDER BY day))
SELECT event_type, day, {r('mean', 'mean')}, {r('(a + mean + b) / 3', 'smooth')} FROM w""")
def moving_mean_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.moving_mean(_daily(spark, sf_dir).drop("n"), ["event_type"], "day", "mean"), "mean", "smooth")


@query(f"""WITH {_DAILY}, w AS (
  SELECT event_type, day, mean, (coalesce(lag(mean) OVER o, mean) + mean + coalesce(lead(mean) OVER o, mean)) / 3 AS smooth FROM daily WINDOW o AS (PARTITION BY event_type ORDER BY day)
), a AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, day) AS k FROM w
), b AS (SELECT event_type, day, row_number() OVER (PARTITION BY event_type ORDER BY smooth DESC, day) AS k FROM w)
SELECT a.event_type, a.day AS raw_peak, b.day AS smooth_peak FROM a JOIN b USING (event_type) WHERE a.k = 1 AND b.k = 1""")
def peak_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.moving_mean(_daily(spark, sf_dir), ["event_type"], "day", "mean")
    best = lambda y: F.max_by("day", F.struct(F.col(y), -F.col("day")))
    return s.groupBy("event_type").agg(best("mean").alias("raw_peak"), best("smooth").alias("smooth_peak"))


@query(f"""WITH {_DAILY}, k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS a, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS d FROM daily
), m AS (SELECT event_type, avg(mean) FILTER (a <= 5) AS early, avg(mean) FILTER (d <= 5) AS late FROM k GROUP BY event_type HAVING count(*) >= 5)
SELECT event_type, {r('early', 'early')}, {r('late', 'late')}, {r('late - early', 'shift')} FROM m""")
def early_late_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.early_late_shift(_daily(spark, sf_dir), ["event_type"], "day", "mean"), "early", "late", "shift")


_VARIANTS = """members AS (
  SELECT x.variant, d.doc_id, (2000 + substr(d.source, 4)::INT)::INT AS year FROM documents d,
    (VALUES ('all'), ('english'), ('long'), ('not_toxic'), ('english_again')) x(variant) LEFT JOIN labels l ON l.doc_id = d.doc_id
  WHERE CASE x.variant WHEN 'all' THEN true WHEN 'long' THEN d.n_chars > 1000 WHEN 'not_toxic' THEN coalesce(l.toxic, 0) = 0 ELSE d.lang = 'en' END
), cosines AS (SELECT vec_id AS doc_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS cos FROM embeddings
), ms AS (SELECT members.*, cos FROM members JOIN cosines USING (doc_id)
), va AS (SELECT variant, year, count(*) AS n, avg(cos) AS mean FROM ms WHERE year BETWEEN 2000 AND 2024 GROUP BY variant, year HAVING count(*) >= 5
), ids AS (SELECT variant, count(DISTINCT doc_id) AS raw_records, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS id_set_sha256 FROM ms GROUP BY variant
), vt AS (""" + M.trend_sql("va", ["variant"]) + """), res AS (
  SELECT ids.variant, raw_records, id_set_sha256, (SELECT sum(n) FROM va WHERE va.variant = ids.variant)::BIGINT AS analyzed_records, vt.n_points AS n_years, vt.tau FROM ids JOIN vt ON vt.variant = ids.variant
)"""


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, doc_id, year, cos): what each of five definitions retrieves."""
    d = M.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", M.year_of(F.col("source")).alias("year"))
    d = d.join(M.read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    english = F.col("lang") == "en"
    rules = {"all": F.lit(True), "english": english, "long": F.col("n_chars") > 1000, "not_toxic": F.coalesce("toxic", F.lit(0)) == 0, "english_again": english}
    each = F.filter(F.array(*[F.when(rule, name) for name, rule in rules.items()]), lambda v: v.isNotNull())
    e = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), V.cosine(F.col("embedding"), F.lit(M.anchor(spark, sf_dir, 0))).alias("cos"))
    return d.select("doc_id", "year", F.explode(each).alias("variant")).join(e, "doc_id")


@query(f"WITH {_VARIANTS} SELECT variant, raw_records, analyzed_records, n_years, {r('tau', 'tau')}, CASE WHEN tau < -0.05 THEN 'negative' WHEN tau > 0.05 THEN 'positive' ELSE 'flat' END AS direction, id_set_sha256 FROM res")
def retrieval_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.variants(_members(spark, sf_dir), ["variant"]), "tau")


@query(f"""WITH {_VARIANTS} SELECT count(*) AS n_variants, count(DISTINCT id_set_sha256) AS unique_sets, {r('min(tau)', 'tau_min')}, {r('max(tau)', 'tau_max')},
  count_if(tau < 0)::BIGINT AS negative, count_if(tau > 0)::BIGINT AS positive FROM res""")
def query_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Q.query_summary(Q.variants(_members(spark, sf_dir), ["variant"]), []), "tau_min", "tau_max")


@query("SELECT lang, count(DISTINCT doc_id) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id)) AS id_set_sha256 FROM documents GROUP BY lang")
def idset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.set_digests(M.read(spark, sf_dir, "documents"), ["lang"], "doc_id")


@query("""SELECT sha256(text) AS text_sha256, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY sha256(text)""")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = M.read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    first = Q.first_wins(d, ["text_sha256"], ["doc_id"]).select("text_sha256", F.col("doc_id").alias("first_id"))
    return first.join(Q.last_wins(d, ["text_sha256"], ["doc_id"]).select("text_sha256", F.col("doc_id").alias("last_id")), "text_sha256")


@query(f"WITH {_VARIANTS} SELECT doc_id, count(DISTINCT variant) AS variants FROM ms WHERE variant <> 'all' GROUP BY doc_id")
def union_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).filter("variant != 'all'").groupBy("doc_id").agg(F.count_distinct("variant").alias("variants"))


@query()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pca_summary(A.centroids(M.corpus(spark, sf_dir), ["year"]))


@query()
def pca_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pca_scores(A.centroids(M.corpus(spark, sf_dir), ["year"]))


@query()
def term_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = M.read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("term"), F.col("embedding").alias("vector"))
    return G.term_loadings(A.centroids(M.corpus(spark, sf_dir), ["year"]), terms)


@query(f"WITH {_DAILY}, t AS ({M.trend_sql('daily', ['event_type'], 'day')}) SELECT event_type, printf('%.3f', round(tau, 3)) AS tau_text FROM t")
def formatted_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.trend(_daily(spark, sf_dir), ["event_type"], x="day")
    return t.select("event_type", F.format_string("%.3f", F.round("tau", 3)).alias("tau_text"))
