"""Extension queries over events, by the operators that also serve streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.plans import model as M
from halyard.plans.corpus_queries import rounded
from halyard.streaming.windows import sessions, tumbling_means


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tumbling_means(M.read(spark, sf_dir, "events"))
    return rounded(w.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", "mean"), "mean")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(M.read(spark, sf_dir, "events")).groupBy("user_id").agg(F.count("*").cast("long").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {"event_windows": event_windows, "event_sessions": event_sessions}
ORACLE = {
    "event_windows": "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) + 0.0 AS mean FROM events GROUP BY 1, 2",
    "event_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events
), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY user_id, k)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id""",
}
