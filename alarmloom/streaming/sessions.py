"""Episodes from a stream: the batch rule as a session window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_sessions(events: DataFrame, gap_minutes: float = 30.0, lateness: str = "1 hour") -> DataFrame:
    """Sessions of each machine and split with their first and last time and number of events.

    ``events`` (batch or stream) has timestamp, machine_id and alarm_code, and split if there are splits; a
    stream knows none, as they need the whole log. Events a gap apart or less share a session, as in the batch rule.
    Rows later than ``lateness`` behind the newest are dropped. Sessions come out once the watermark has passed them.
    """
    keys = ["machine_id"] + (["split"] if "split" in events.columns else [])
    timed = events.withColumn("event_time", F.col("timestamp").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("event_time", lateness)
    session = F.session_window("event_time", f"{round(gap_minutes * 60_000_000)} microseconds")
    grouped = timed.groupBy(*keys, session).agg(
        F.min("event_time").alias("start"), F.max("event_time").alias("end"), F.count(F.lit(1)).alias("event_count"), F.min_by("alarm_code", "event_time").alias("first_alarm_code"), F.max_by("alarm_code", "event_time").alias("last_alarm_code")
    )
    return grouped.select(*keys, F.col("start").cast("timestamp_ntz").alias("start_time"), F.col("end").cast("timestamp_ntz").alias("end_time"), "event_count", "first_alarm_code", "last_alarm_code")


def write_sessions(events: DataFrame, path: str, checkpoint: str, gap_minutes: float = 30.0, lateness: str = "1 hour"):
    """Starts a query that appends finished sessions to Parquet; the checkpoint makes it exactly once."""
    return streaming_sessions(events, gap_minutes, lateness).writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).start()
