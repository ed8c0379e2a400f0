"""What follows each episode within a horizon: the open-closed window (end, end + horizon]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import horizon_micros, micros, time_of

#: Time buckets in a horizon. Of a window, only events in its first and last bucket are looked at one by one.
BUCKETS_PER_HORIZON = 8


def future_events(episodes: DataFrame, events: DataFrame, scope: tuple[str, ...], hours: float) -> DataFrame:
    """(incident_id, alarm_code, n): how often each code follows each episode in its scope.

    Time is cut into buckets. Buckets wholly inside a window give a total a code; the two at its
    ends give their events. Both are one equality join on scope and bucket, so a hot
    scope is spread over its buckets, and a busy one meets an episode with a row a code and bucket.
    """
    h = horizon_micros(hours)
    width = max(1, -(-h // BUCKETS_PER_HORIZON))

    def bucket(us: Column) -> Column:
        return F.floor(us / F.lit(width)).cast("long")

    first, last = bucket(F.col("end_us") + 1), bucket(F.col("end_us") + h)
    ends = episodes.select("incident_id", *scope, micros("end_time").alias("end_us"))
    asked = ends.withColumn("bucket", F.explode(F.sequence(first, last))).withColumn("edge", (F.col("bucket") == first) | (F.col("bucket") == last))
    timed = events.select(*scope, "alarm_code", micros("timestamp").alias("us")).withColumn("bucket", bucket(F.col("us")))
    count = F.count(F.lit(1)).alias("n")
    totals = timed.groupBy(*scope, "bucket", "alarm_code").agg(count).withColumns({"us": F.lit(None).cast("long"), "edge": F.lit(False)})
    times = timed.groupBy(*scope, "bucket", "alarm_code", "us").agg(count).withColumn("edge", F.lit(True))
    near = asked.join(times.unionByName(totals), [*scope, "bucket", "edge"])
    inside = ~F.col("edge") | ((F.col("us") > F.col("end_us")) & (F.col("us") <= F.col("end_us") + h))
    return near.where(inside).groupBy("incident_id", "alarm_code").agg(F.sum("n").alias("n"))


def observed_through(events: DataFrame, scope: tuple[str, ...]) -> DataFrame:
    """Last event time of each scope."""
    return events.groupBy(*scope).agg(F.max(micros("timestamp")).alias("last_us"))


def with_future(episodes: DataFrame, events: DataFrame, scope: tuple[str, ...], hours: float) -> DataFrame:
    """``episodes`` with end_us, future (array of code and count, by code), last_us of the scope, and is_complete."""
    h = horizon_micros(hours)
    counted = future_events(episodes, events, scope, hours).groupBy("incident_id").agg(F.array_sort(F.collect_list(F.struct("alarm_code", "n"))).alias("future"))
    step = episodes.withColumn("end_us", micros("end_time")).join(observed_through(events, scope), list(scope), "left").join(counted, "incident_id", "left")
    none = F.array().cast("array<struct<alarm_code:string,n:bigint>>")
    return step.withColumn("future", F.coalesce("future", none)).withColumn("is_complete", F.coalesce(F.col("last_us") >= F.col("end_us") + h, F.lit(False)))


def codes_of(future: str = "future") -> Column:
    return F.transform(future, lambda x: x["alarm_code"])


def event_count(future: str = "future") -> Column:
    return F.aggregate(future, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def future_outcomes(episodes: DataFrame, events: DataFrame, hours: float) -> DataFrame:
    """Outcomes of all episodes on their machines; windows may reach into the next split.

    A machine without events gives no observation: null, incomplete, no codes.
    """
    base = with_future(episodes.select("incident_id", "machine_id", "end_time"), events, ("machine_id",), hours)
    return base.select(
        "incident_id",
        F.col("end_time").alias("outcome_start_time"),
        time_of(F.col("end_us") + horizon_micros(hours)).alias("outcome_end_time"),
        time_of("last_us").alias("outcome_observed_through"),
        F.col("is_complete").alias("outcome_is_complete"),
        F.lit(float(hours)).alias("future_horizon_hours"),
        event_count().alias("future_event_count"),
        F.size("future").cast("long").alias("distinct_future_alarm_count"),
        codes_of().alias("future_alarm_codes"),
        (F.size("future") > 0).alias("has_future_alarms"),
    )


def forecast_labels(episodes: DataFrame, events: DataFrame, hours: float) -> DataFrame:
    """Labels of all episodes; windows and observation end with the episode's own split."""
    base = with_future(episodes.select("incident_id", "machine_id", "split", "end_time"), events, ("machine_id", "split"), hours)
    return base.select(
        "incident_id",
        "machine_id",
        "split",
        F.col("end_time").alias("prediction_time"),
        time_of(F.col("end_us") + horizon_micros(hours)).alias("forecast_end_time"),
        time_of("last_us").alias("outcome_observed_through"),
        F.col("is_complete").alias("outcome_is_complete"),
        F.lit(float(hours)).alias("forecast_horizon_hours"),
        event_count().alias("future_event_count"),
        F.size("future").cast("long").alias("distinct_future_alarm_count"),
        codes_of().alias("future_alarm_codes"),
        F.col("future").alias("future_alarm_counts"),
        (F.size("future") > 0).alias("has_future_alarms"),
    )
