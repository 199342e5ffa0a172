"""The events as live streams: what is put aside, windows of event time, and clocks that are ready."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.queries.plans import live_events, stream_folder, streamed
from tonelake.streaming import live


def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples, some without a channel, a number or a finite value: how many of each channel go on and how many aside."""
    folder, i = stream_folder(spark), F.col("event_id")
    samples = live_events(spark, sf_dir).select(
        F.when(i % 101 != 0, F.col("event_type")).alias("channel"), F.when(i % 103 == 0, -1).otherwise(i).alias("idx"), F.when(i % 97 == 0, float("nan")).when(i % 89 == 0, float("inf")).otherwise(F.col("value") / 500).alias("x")
    )
    to = lambda name: lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    query = samples.writeStream.option("checkpointLocation", f"{folder}/state").foreachBatch(live.quarantining(to("kept"), to("aside"))).trigger(availableNow=True).start()
    query.awaitTermination()
    kept, aside = (spark.read.parquet(f"{folder}/{name}").select("channel", F.lit(name).alias("way")) for name in ("kept", "aside"))
    return kept.unionByName(aside).groupBy("channel").agg(F.count_if(F.col("way") == "kept").alias("kept"), F.count_if(F.col("way") == "aside").alias("aside"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type by day, as far as days are final: two days after the newest event nothing more is waited for."""
    folder = stream_folder(spark)
    windows = live.event_windows(live_events(spark, sf_dir), "ts", "event_type", "1 day", "2 days")
    query = windows.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{folder}/out/batch={n}")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "rows")


def stream_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each channel's clock has come a quarter of a second far, at 8000 samples a second."""
    return streamed(spark, sf_dir, lambda s: live.ready(s, 8000), "update", ["channel"], "frames")


SQL = {
    "stream_quarantine": """WITH e AS (SELECT CASE WHEN event_id % 101 <> 0 THEN event_type END AS channel, event_id % 101 <> 0 AND event_id % 103 <> 0 AND event_id % 97 <> 0 AND event_id % 89 <> 0 AS whole FROM events)
SELECT channel, count(*) FILTER (whole) AS kept, count(*) FILTER (NOT whole) AS aside FROM e GROUP BY channel""",
    "stream_windows": """SELECT strftime(d, '%Y-%m-%d') AS day, event_type, count(*) AS rows FROM (SELECT date_trunc('day', ts) AS d, event_type FROM events)
WHERE d + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events) GROUP BY d, event_type""",
    "stream_ready": "SELECT event_type AS channel, count(*) AS frames, count(*) >= 2000 AS ready FROM events GROUP BY event_type",
}

QUERIES = [stream_quarantine, stream_windows, stream_ready]
