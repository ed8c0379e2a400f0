"""Profiles of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, ratio
from .ingest import add_gaps

EVENT_KEY = ("timestamp", "alarm_code", "machine_id")


def dataset_overview(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("machine_id").alias("machine_count"),
        F.countDistinct("alarm_code").alias("alarm_code_count"),
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
    )


def duplicate_groups(events: DataFrame) -> DataFrame:
    """Groups of events that agree in time, code and machine."""
    return events.groupBy(*EVENT_KEY).agg(F.count(F.lit(1)).alias("duplicate_group_size")).where(F.col("duplicate_group_size") > 1)


#: Rows of a file, and units of those, that are looked at one after another.
UNITS = (65_536, 65_536 * 4_096)


def steps_back(rows: DataFrame, *group: str) -> DataFrame:
    """One row: how often ``us`` falls from one source_row to the next within ``group`` (all rows, without one).

    Counted inside units of rows, then between units of a larger one, then between those: a unit
    is known by its first and last time and the steps inside it, so each window sees a few thousand rows.
    """
    state = rows.select(*group, F.col("source_row").alias("place"), F.col("us").alias("first"), F.col("us").alias("last"), F.lit(0).cast("long").alias("steps"))
    for size in (*UNITS, None):
        unit = F.lit(0).cast("long") if size is None else F.floor(F.col("place") / size).cast("long")
        dealt = state.withColumn("unit", unit)
        fell = F.coalesce(F.col("first") < F.lag("last").over(Window.partitionBy(*group, "unit").orderBy("place")), F.lit(False))
        dealt = dealt.withColumn("steps", F.col("steps") + fell.cast("long"))
        state = dealt.groupBy(*group, "unit").agg(F.min("place").alias("place"), F.min_by("first", "place").alias("first"), F.max_by("last", "place").alias("last"), F.sum("steps").alias("steps")).drop("unit")
    return state.agg(F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"))


def time_reversals(events: DataFrame) -> DataFrame:
    """How often time steps back from one row to the next, over all rows and within machines."""
    timed = events.select("machine_id", "source_row", micros("timestamp").alias("us"))
    overall, within = steps_back(timed), steps_back(timed, "machine_id")
    return overall.withColumnRenamed("steps", "global_time_reversal_count").join(within.withColumnRenamed("steps", "within_machine_time_reversal_count"))


def data_quality(events: DataFrame) -> DataFrame:
    """One row: duplicate groups, the rows in them and those in excess, and steps back in time."""
    groups = duplicate_groups(events).agg(
        F.count(F.lit(1)).alias("exact_duplicate_group_count"),
        F.coalesce(F.sum("duplicate_group_size"), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.sum(F.col("duplicate_group_size") - 1), F.lit(0)).alias("duplicate_excess_row_count"),
    )
    return groups.join(time_reversals(events))


def with_share(profile: DataFrame) -> DataFrame:
    """Adds the share of all events; profiles have a row a machine, code or month."""
    return profile.withColumn("event_share", ratio(F.col("event_count"), F.sum("event_count").over(Window.partitionBy())))


def machine_profile(events: DataFrame) -> DataFrame:
    profile = events.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("alarm_code").alias("alarm_code_count"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time")
    )
    return with_share(profile).select("machine_id", "event_count", "event_share", "alarm_code_count", "start_time", "end_time").orderBy(F.col("event_count").desc(), "machine_id")


def alarm_profile(events: DataFrame) -> DataFrame:
    profile = with_share(events.groupBy("alarm_code").agg(F.count(F.lit(1)).alias("event_count"), F.countDistinct("machine_id").alias("machine_count")))
    up_to = Window.orderBy(F.col("event_count").desc(), "alarm_code").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = ratio(F.sum("event_count").over(up_to), F.sum("event_count").over(Window.partitionBy()))
    return profile.withColumn("cumulative_share", cumulative).select("alarm_code", "event_count", "event_share", "cumulative_share", "machine_count").orderBy(F.col("event_count").desc(), "alarm_code")


def monthly_profile(events: DataFrame) -> DataFrame:
    month = F.date_trunc("month", F.col("timestamp").cast("timestamp")).cast("timestamp_ntz")
    profile = events.groupBy(month.alias("month_start")).agg(
        F.count(F.lit(1)).alias("event_count"), F.countDistinct("machine_id").alias("machine_count"), F.countDistinct("alarm_code").alias("alarm_code_count")
    )
    return with_share(profile).select("month_start", "event_count", "event_share", "machine_count", "alarm_code_count").orderBy("month_start")


def gap_threshold_profile(events: DataFrame, minutes: tuple[float, ...]) -> DataFrame:
    """For each threshold the gaps within and beyond it and the episodes they would make, in one pass."""
    gaps = add_gaps(events).select("machine_id", (F.col("gap_seconds") / 60).alias("gap"))
    counts = [F.count_if(F.col("gap") <= float(m)).alias(f"within_{i}") for i, m in enumerate(minutes)]
    one = gaps.agg(F.countDistinct("machine_id").alias("machines"), F.count("gap").alias("gaps"), *counts)
    rows = F.explode(F.array(*(F.struct(F.lit(float(m)).alias("threshold_minutes"), F.col(f"within_{i}").alias("within_threshold_count")) for i, m in enumerate(minutes))))
    broken = F.col("gaps") - F.col("r.within_threshold_count")
    return one.select("machines", "gaps", rows.alias("r")).select(
        "r.threshold_minutes",
        "r.within_threshold_count",
        ratio(F.col("r.within_threshold_count"), F.col("gaps")).alias("within_threshold_share"),
        broken.alias("incident_break_count"),
        (F.col("machines") + broken).alias("estimated_incident_count"),
    )


def overview_tables(events: DataFrame, episodes: DataFrame) -> dict[str, DataFrame]:
    """What an overview page shows: totals, months, the twelve most frequent codes, machines and splits."""
    def count(key: str) -> DataFrame:
        return events.groupBy(key).agg(F.count(F.lit(1)).alias("event_count")).orderBy(F.col("event_count").desc(), key)

    splits = events.sparkSession.createDataFrame([("train",), ("validation",), ("test",)], "split string")
    sizes = episodes.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return {
        "totals": dataset_overview(events).join(episodes.agg(F.count(F.lit(1)).alias("incident_count"))),
        "months": monthly_profile(events).select("month_start", "event_count"),
        "top_alarms": count("alarm_code").limit(12),
        "machines": count("machine_id"),
        "splits": splits.join(sizes, "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("incident_count")),
    }
