"""Extension: the same series kept up to date from a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_means(events: DataFrame, width: str = "1 day", late: str = "1 hour", value: str = "value", by: str = "event_type") -> DataFrame:
    """(by, start, n, mean) of each window; works on streams, where rows later than ``late`` are left out, and on tables."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(by, F.window("ts", width).alias("w")).agg(F.count("*").cast("long").alias("n"), F.avg(value).alias("mean")).select(by, F.col("w.start").alias("start"), "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """(by, start, n) of each run of events with pauses under ``gap``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    return rows.groupBy(by, F.session_window("ts", gap).alias("w")).agg(F.count("*").cast("long").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def drain(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that is there now, to Parquet, each row once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
