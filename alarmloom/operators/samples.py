"""Input and output windows of alarm sequences, their clean-up and padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import micros

MINUTE = 60_000_000


def windowed(events: DataFrame, offsets: tuple[int, ...], input_minutes: int, output_minutes: int) -> DataFrame:
    """Each event in its input window and in its output window, for each offset.

    Windows of ``input_minutes`` stand side by side from the machine's first event plus
    the offset; the output of a window is the ``output_minutes`` after it, which must
    not be longer. Columns: machine_id, start_offset, bin, part ("x", "y"), us, source_row, alarm_code.
    """
    if not 0 < output_minutes <= input_minutes:
        raise ValueError("the output must be above zero and at most as long as the input")
    width, out = input_minutes * MINUTE, output_minutes * MINUTE
    timed = events.withColumn("us", micros("timestamp"))
    firsts = timed.groupBy("machine_id").agg(F.min("us").alias("first"))  # a row a machine, so no machine's log meets in one task
    anchored = timed.join(firsts, "machine_id").withColumn("start_offset", F.explode(F.array(*map(F.lit, offsets))))
    since = F.col("us") - F.col("first") - F.col("start_offset").cast("long") * F.lit(MINUTE)
    place = anchored.withColumn("since", since).where(F.col("since") >= 0).withColumn("bin", F.floor(F.col("since") / F.lit(width)).cast("long"))
    base = ("machine_id", "start_offset", "us", "source_row", "alarm_code")
    x = place.select(*base, "bin", F.lit("x").alias("part"))
    y = place.where((F.col("bin") >= 1) & (F.col("since") - F.col("bin") * F.lit(width) < out)).select(*base, (F.col("bin") - 1).alias("bin"), F.lit("y").alias("part"))
    return x.unionByName(y)


def collapse(codes: Column) -> Column:
    """Runs of one code become one."""
    return F.filter(codes, lambda x, i: (i == 0) | (F.get(codes, i - 1) != x))


def paired_sequences(events: DataFrame, offsets: tuple[int, ...], input_minutes: int, output_minutes: int, least: int = 1) -> DataFrame:
    """Windows with both an input and an output of at least ``least`` events, as sequences in time order."""
    return sequences_of(windowed(events, offsets, input_minutes, output_minutes), least)


def sequences_of(rows: DataFrame, least: int = 1) -> DataFrame:
    """The sequences of rows of ``windowed``."""

    def sequence(part: str) -> Column:
        picked = F.collect_list(F.when(F.col("part") == part, F.struct("us", "source_row", "alarm_code")))
        return F.transform(F.array_sort(picked), lambda e: e["alarm_code"]).alias(part)

    grouped = rows.groupBy("machine_id", "start_offset", "bin").agg(sequence("x"), sequence("y"))
    return grouped.where((F.size("x") >= max(1, least)) & (F.size("y") >= max(1, least)))


def padded_samples(pairs: DataFrame, sigma: float = 3.0, drop: tuple[str, ...] = (), keep: tuple[str, ...] = (), before: bool = False, train: float = 0.7) -> DataFrame:
    """Collapsed sequences, cut and padded with "0" to common lengths, with their part of the data.

    ``drop``: codes left out of inputs; ``keep``: the only codes of outputs, if any. Inputs are cut at mean plus sigma deviations,
    outputs at the longest. The first 70 % of the windows of each machine and offset are train; where there is one window only it is left out.
    """
    x = F.filter("x", lambda c: ~c.isin(*drop)) if drop else F.col("x")
    y = F.filter("y", lambda c: c.isin(*keep)) if keep else F.col("y")
    clean = pairs.withColumn("x", x).withColumn("y", y)
    clean = clean.withColumn("x", collapse(F.col("x"))).withColumn("y", collapse(F.col("y")))
    sizes = clean.agg(F.avg(F.size("x")).alias("mean"), F.stddev_pop(F.size("x")).alias("std"), F.max(F.size("y")).alias("most")).first()  # one row
    if sizes["mean"] is None:
        x_length = y_length = 1
    else:
        x_length, y_length = int(sizes["mean"] + sigma * sizes["std"]) + 1, max(1, sizes["most"])

    def pad(codes: Column, length: int) -> Column:
        cut = F.slice(codes, 1, length)
        zeros = F.array_repeat(F.lit("0"), F.lit(length) - F.size(cut))
        return F.concat(zeros, cut) if before else F.concat(cut, zeros)

    own = Window.partitionBy("machine_id", "start_offset")
    step = clean.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("i", F.row_number().over(own.orderBy("bin"))).where(F.col("n") > 1)
    part = F.when(F.col("i") <= F.col("n") - F.ceil(F.col("n") * F.lit(1 - train)), "train").otherwise("test")
    return step.select("machine_id", "start_offset", "bin", pad(F.col("x"), x_length).alias("x"), pad(F.col("y"), y_length).alias("y"), part.alias("part"))
