"""Samples of a whole log for a grid of settings, in three stored phases, and their JSON forms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import samples as S
from .artifacts import write_frame

#: Phases and the Parquet folder that each writes and the next one reads.
PHASES = ("windows", "sequences", "samples")
SAMPLE = "machine_id string, start_offset int, bin long, x array<string>, y array<string>, part string"
#: Fixed keys of the published form: one object of named samples.
PUBLISHED = "map<string, struct<x_train: array<string>, y_train: array<string>, x_test: array<string>, y_test: array<string>, serial: string>>"


@dataclass(frozen=True)
class SampleSettings:
    """One cell of a grid. Windows start at every ``offset_step`` minutes of an input window."""

    input_minutes: int
    output_minutes: int
    offset_step: int
    min_count: int = 1
    sigma: float = 3.0
    drop: tuple[str, ...] = ()
    keep: tuple[str, ...] = ()
    pad_before: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.output_minutes <= self.input_minutes or self.offset_step <= 0:
            raise ValueError("windows and the step must be above zero and outputs at most as long as inputs")

    @property
    def offsets(self) -> tuple[int, ...]:
        return tuple(range(0, self.input_minutes, self.offset_step))

    @property
    def name(self) -> str:
        return f"input_{self.input_minutes}_output_{self.output_minutes}_step_{self.offset_step}_count_{self.min_count}_sigma_{self.sigma:g}"


def parameter_grid(inputs: Iterable[int], outputs: Iterable[int], min_counts: Iterable[int], sigmas: Iterable[float], offset_steps: Iterable[int], **shared) -> list[SampleSettings]:
    """A cell for each combination; ``shared`` holds the settings that all have in common."""
    cells = product(inputs, outputs, min_counts, sigmas, offset_steps)
    return [SampleSettings(i, o, step, least, sigma, **shared) for i, o, least, sigma, step in cells]


def create_samples(events: DataFrame, grid: Iterable[SampleSettings], folder: str, start: int = 1) -> dict[str, DataFrame]:
    """The stored samples of each cell, by name.

    Phase 1 puts events into windows, 2 makes pairs of sequences, 3 cleans, pads and divides them.
    From ``start`` on phases are run; those before must have been stored by an earlier run.
    """
    if start not in (1, 2, 3):
        raise ValueError("start must be 1, 2 or 3")
    spark, done = events.sparkSession, {}
    for one in grid:
        windows, sequences, samples = (f"{folder.rstrip('/')}/{one.name}/{phase}" for phase in PHASES)
        if start <= 1:
            write_frame(S.windowed(events, one.offsets, one.input_minutes, one.output_minutes), windows)
        if start <= 2:
            write_frame(S.sequences_of(spark.read.parquet(windows), one.min_count), sequences)
        write_frame(S.padded_samples(spark.read.parquet(sequences), one.sigma, one.drop, one.keep, one.pad_before), samples)
        done[one.name] = spark.read.parquet(samples)
    return done


def write_samples(samples: DataFrame, path: str) -> None:
    """A line of JSON a sample, in as many files as there are partitions."""
    samples.write.mode("overwrite").option("compression", "gzip").json(path)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of ``write_samples``; a line that is no sample raises."""
    return spark.read.schema(SAMPLE).option("mode", "FAILFAST").json(path)


def read_published_samples(spark: SparkSession, path: str) -> DataFrame:
    """(machine_id, x, y, part) of files in the published form, an object of named samples each.

    A file is one JSON document and so one task's work; several are read side by side. ``y`` holds the outputs.
    """
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", PUBLISHED, {"mode": "FAILFAST"}).alias("held"))
    each = held.select(F.explode("held").alias("name", "s"))
    part = F.when(F.col("s.x_train").isNotNull(), "train").otherwise("test")
    return each.select(F.col("s.serial").alias("machine_id"), F.coalesce("s.x_train", "s.x_test").alias("x"), F.coalesce("s.y_train", "s.y_test").alias("y"), part.alias("part"))
