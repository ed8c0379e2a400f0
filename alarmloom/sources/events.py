"""Alarm events from CSV, Parquet and the test tables, and the contract they must meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The columns of a raw log.
RAW_COLUMNS = ("timestamp", "alarm", "serial")
EVENT_COLUMNS = ("timestamp", "alarm_code", "machine_id", "source_row")


class ContractError(ValueError):
    """Raw data that breaks the contract."""


def check_columns(columns: list[str]) -> None:
    missing, extra = sorted(set(RAW_COLUMNS) - set(columns)), sorted(set(columns) - set(RAW_COLUMNS))
    if missing or extra or len(columns) != len(RAW_COLUMNS):
        raise ContractError(f"columns must be {', '.join(RAW_COLUMNS)}; missing: {missing}, not expected: {extra}")


def parsed_time(column: str = "timestamp"):
    """Time with one to six digits of a second's fraction, else null."""
    text = F.when(F.col(column).rlike(r"\A\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{1,6}\z"), F.col(column))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]")).cast("timestamp_ntz")


def check_raw(raw: DataFrame) -> None:
    """Raises ContractError for nulls, identifiers that are not all digits, and times that cannot be read; one pass."""
    check_columns(raw.columns)
    tests = {f"null {c}": F.col(c).isNull() for c in RAW_COLUMNS}
    tests |= {f"{c} is not all digits": ~F.col(c).rlike(r"\A[0-9]+\z") for c in ("alarm", "serial")}
    tests["timestamp cannot be read"] = F.col("timestamp").isNotNull() & parsed_time().isNull()
    counts = raw.agg(*(F.count_if(F.coalesce(t, F.lit(False))).alias(n) for n, t in tests.items())).first().asDict()
    broken = {n: k for n, k in counts.items() if k}
    if broken:
        raise ContractError(f"rows that break the contract: {broken}")


def normalized(raw: DataFrame, parts: tuple[str, ...], line: str) -> DataFrame:
    """Events with names and types of the engine; source_row is the place by ``parts``, then ``line``, from 0.

    The places are made in two steps, each part's rows on their own and the parts' totals before
    them, so that no task orders all rows; only the totals, a row a part, go through one.
    """
    inside = Window.partitionBy(*parts).orderBy(line)
    numbered = raw.withColumn("__inside", F.row_number().over(inside) - 1)
    before = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
    starts = raw.groupBy(*parts).count().select(*parts, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    placed = numbered.join(starts, list(parts))
    return placed.select(parsed_time().alias("timestamp"), F.col("alarm").alias("alarm_code"), F.col("serial").alias("machine_id"), (F.col("__start") + F.col("__inside")).cast("long").alias("source_row"))


def read_alarm_csv(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """Events of a CSV log with a header, all columns read as text; source_row is the line's number without the header, from 0.

    Of several files, each with the same header, the lines of one follow those of the one before it by name.
    With ``validate`` broken rows raise at once, before anything lazy is returned.
    """
    header = spark.read.text(path).limit(1).first()
    check_columns([c.strip().strip('"') for c in header[0].split(",")] if header else [])
    schema = ", ".join(f"{c} string" for c in header[0].replace('"', "").split(","))
    raw = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    if validate:
        check_raw(raw.select(*RAW_COLUMNS))
    # a block of a file is read from its start to its end by one task, so ids rise with its lines
    lines = raw.select(*RAW_COLUMNS, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__line"))
    return normalized(lines, ("__file", "__block"), "__line")


def write_alarm_csv(events: DataFrame, path: str, files: int = 4) -> None:
    """The events as a CSV log that ``read_alarm_csv`` reads back, in order of source_row over ``files`` files at most."""
    raw = events.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.col("alarm_code").alias("alarm"), F.col("machine_id").alias("serial"), "source_row")
    raw.repartitionByRange(files, "source_row").sortWithinPartitions("source_row").drop("source_row").write.mode("overwrite").csv(path, header=True)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def table_events(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """The ``events`` test table as an alarm log of 20 machines.

    ``dense``: times cut to the hour and event types as codes, which gives ties, exact
    duplicates and states with many samples.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    time = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz") if dense else F.col("ts")
    code = F.col("event_type") if dense else F.get_json_object("props", "$.k")
    return events.select(time.alias("timestamp"), code.alias("alarm_code"), (F.col("user_id") % 20).cast("string").alias("machine_id"), F.col("event_id").alias("source_row"))
