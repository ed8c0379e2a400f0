"""Duplicates, gaps and chronological splits: raw events to processed events."""

from __future__ import annotations

from math import isclose

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros, time_of
from ..functions.storage import stored

PROCESSED_COLUMNS = ("timestamp", "alarm_code", "machine_id", "source_row", "duplicate_group_size", "is_exact_duplicate", "previous_timestamp", "gap_seconds", "split")
SPLITS = ("train", "validation", "test")


#: Time that one block of a machine's log spans at most, in microseconds: a day.
BLOCK = 86_400_000_000
#: Events of a machine's day beyond which it is cut, and the number of parts then, of near equal size.
MOST_IN_BLOCK, PARTS = 1 << 18, 256


def in_blocks(events: DataFrame) -> DataFrame:
    """Adds us and block, and puts each block into one partition: a day of one machine, or a part of a day with very many events.

    Windows go over blocks, so there are as many tasks as blocks allow; what a block
    needs of those before it is worked out from a row a block. Numbers of blocks grow with time, and events of
    one machine and time are in one block. Machine and time are
    not null in a log that meets its contract; a row without them is a block of its own.
    """
    step = events.withColumn("us", micros("timestamp")).withColumn("block", F.floor(F.col("us") / F.lit(BLOCK)).cast("long") * 2 * PARTS)
    days = step.groupBy("machine_id", "block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_BLOCK)
    if not days.isEmpty():
        # stored, as bounds found twice may differ
        hot = days.select(F.col("machine_id").alias("__machine"), F.col("block").alias("__day"))
        busy = step.join(hot, (F.col("machine_id") == F.col("__machine")) & (F.col("block") == F.col("__day")), "left_semi")
        shares = [i / PARTS for i in range(1, PARTS)]
        cuts = stored(busy.groupBy("machine_id", "block").agg(F.array_distinct(F.percentile_approx("us", shares)).alias("__cuts")))
        part = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.col("us"))), F.lit(0))
        step = step.join(cuts, ["machine_id", "block"], "left").withColumn("block", F.col("block") + part).select(*step.columns)
    return step.repartition("machine_id", "block")


def by_block() -> Window:
    return Window.partitionBy("machine_id", "block").orderBy("us", "source_row")


def with_earlier_blocks(events: DataFrame) -> DataFrame:
    """``in_blocks`` with the machine's last time before the block, its number of distinct times before it, and that of its whole log."""
    dealt = in_blocks(events)
    ends = dealt.groupBy("machine_id", "block").agg(F.max("us").alias("end_us"), F.count_distinct("us").alias("times"))
    machine = Window.partitionBy("machine_id")
    earlier = machine.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "machine_id",
        "block",
        F.lag("end_us").over(machine.orderBy("block")).alias("__before_us"),
        F.coalesce(F.sum("times").over(earlier), F.lit(0)).alias("__before_times"),
        F.sum("times").over(machine).alias("__times"),
    )
    return dealt.join(carried, ["machine_id", "block"], "left")


def duplicates_in_blocks(blocks: DataFrame) -> DataFrame:
    same = Window.partitionBy("machine_id", "block", "timestamp", "alarm_code")
    return blocks.withColumn("duplicate_group_size", F.count(F.lit(1)).over(same)).withColumn("is_exact_duplicate", F.col("duplicate_group_size") > 1)


def gaps_in_blocks(blocks: DataFrame) -> DataFrame:
    step = blocks.withColumn("__previous", F.coalesce(F.lag("us").over(by_block()), F.col("__before_us")))
    return step.withColumn("previous_timestamp", time_of("__previous")).withColumn("gap_seconds", (F.col("us") - F.col("__previous")) / F.lit(1e6))


def splits_in_blocks(blocks: DataFrame, train: float, validation: float, test: float) -> DataFrame:
    if min(train, validation, test) <= 0 or not isclose(train + validation + test, 1.0):
        raise ValueError("shares must be above zero and sum to one")
    inside = F.dense_rank().over(Window.partitionBy("machine_id", "block").orderBy("us")) - 1
    step = blocks.withColumn("__place", F.col("__before_times") + inside)

    def cut(share: float):
        return F.floor(F.col("__times").cast("double") * F.lit(share)).cast("long")

    return step.withColumn("split", F.when(F.col("__place") < cut(train), "train").when(F.col("__place") < cut(train + validation), "validation").otherwise("test"))


def mark_duplicates(events: DataFrame) -> DataFrame:
    """Adds the number of events that agree in time, code and machine, and whether it is above one."""
    return duplicates_in_blocks(in_blocks(events)).select(*events.columns, "duplicate_group_size", "is_exact_duplicate")


def add_gaps(events: DataFrame) -> DataFrame:
    """Adds the time of the machine's event before and the seconds since then; null for its first."""
    return gaps_in_blocks(with_earlier_blocks(events)).select(*events.columns, "previous_timestamp", "gap_seconds")


def assign_splits(events: DataFrame, train: float = 0.70, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds the split: each machine's distinct times in order, cut at shares of their number.

    All events of one machine and time are in one split. Cuts are at the whole part of
    the product in binary doubles.
    """
    return splits_in_blocks(with_earlier_blocks(events), train, validation, test).select(*events.columns, "split")


def split_boundaries(events: DataFrame) -> DataFrame:
    """First and last time, and number of events, of each machine's splits, a row a machine."""
    ends = [f(F.when(F.col("split") == s, F.col("timestamp"))).alias(f"{s}_{n}") for s in SPLITS for n, f in (("start", F.min), ("end", F.max))]
    counts = [F.count_if(F.col("split") == s).alias(f"{s}_events") for s in SPLITS]
    return events.groupBy("machine_id").agg(*ends, *counts)


def split_violations(events: DataFrame) -> DataFrame:
    """Machines that lack a split or whose splits overlap in time."""
    ordered = (F.col("train_end") < F.col("validation_start")) & (F.col("validation_end") < F.col("test_start"))
    return split_boundaries(events).where(~F.coalesce(ordered, F.lit(False)))


def check_splits(events: DataFrame) -> None:
    bad = [r.machine_id for r in split_violations(events).select("machine_id").orderBy("machine_id").limit(20).collect()]
    if bad:
        raise ValueError(f"splits are missing or overlap for machines: {', '.join(bad)}")


def processed_events(events: DataFrame, train: float = 0.70, validation: float = 0.15, test: float = 0.15) -> DataFrame:
    """All nine columns. One shuffle into blocks serves every window."""
    blocks = gaps_in_blocks(duplicates_in_blocks(with_earlier_blocks(events)))
    return splits_in_blocks(blocks, train, validation, test).select(*PROCESSED_COLUMNS)
