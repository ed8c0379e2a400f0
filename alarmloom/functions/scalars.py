"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of an episode's identity.
IDENTITY_VERSION = 1
EPISODE_SOURCE = "time_gap_heuristic"


def micros(timestamp: Column | str) -> Column:
    """Microseconds since 1970 of a time without zone; the session's zone is UTC."""
    column = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return F.unix_micros(column.cast("timestamp"))


def time_of(us: Column | str) -> Column:
    """The time without zone of a number of microseconds."""
    column = F.col(us) if isinstance(us, str) else us
    return F.timestamp_micros(column).cast("timestamp_ntz")


def horizon_micros(hours: float) -> int:
    """Microseconds of a horizon in hours, which may have a fraction but must be finite and positive."""
    if not 0 < hours < float("inf"):
        raise ValueError("the horizon must be finite and above zero")
    return round(hours * 3_600_000_000)


def ratio(part: Column | str, whole: Column | str) -> Column:
    """part / whole as a double, null where whole is 0."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    """Harmonic mean; 0 where both are 0."""
    return F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))


def jaccard(left: Column, right: Column) -> Column:
    """Of two sets of strings; 0 for two empty ones."""
    return F.coalesce(ratio(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))


def gap_text(gap_minutes: float) -> str:
    return format(float(gap_minutes), ".12g")


def episode_id(machine: Column, split: Column, start_us: Column, first_row: Column, gap_minutes: float) -> Column:
    """``inc_`` and 16 hex digits of the SHA-256 of the episode's identity as JSON with sorted keys."""
    identity = F.to_json(
        F.struct(
            first_row.cast("long").alias("first_source_row"),
            F.lit(gap_text(gap_minutes)).alias("gap_minutes"),
            F.lit(EPISODE_SOURCE).alias("incident_source"),
            machine.alias("machine_id"),
            F.lit(IDENTITY_VERSION).alias("schema_version"),
            split.alias("split"),
            F.date_format(time_of(start_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("start_time"),
        )
    )
    return F.concat(F.lit("inc_"), F.substring(F.sha2(identity, 256), 1, 16))
