"""Episodes as padded sequences of token numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import TOKEN

#: Numbers with a meaning of their own.
PAD, UNKNOWN, FIRST_TOKEN = 0, 1, 2
UNKNOWN_MACHINE = 0


@dataclass(frozen=True)
class Numbers:
    """Train tokens from 2 and train machines from 1, each in the order of their text. Both are sets of codes, not of rows."""

    tokens: tuple[str, ...]
    machines: tuple[str, ...]


def fit(documents: DataFrame) -> Numbers:
    train = documents.where(F.col("split") == "train")
    tokens = train.select(F.explode(F.regexp_extract_all("alarm_document", F.lit(TOKEN), F.lit(0))).alias("t")).distinct().orderBy("t").collect()
    machines = train.select("machine_id").distinct().orderBy("machine_id").collect()
    return Numbers(tuple(r.t for r in tokens), tuple(r.machine_id for r in machines))


def numbered(names: tuple[str, ...], first: int, key: Column, other: int) -> Column:
    if not names:
        return F.lit(other)
    place = F.array_position(F.array(*map(F.lit, names)), key).cast("int")
    return F.when(place > 0, place + (first - 1)).otherwise(F.lit(other))


def encode(documents: DataFrame, numbers: Numbers, length: int) -> DataFrame:
    """The last ``length`` tokens of each document as numbers, padded on the right, with how many there are and the machine's number."""
    if length < 1:
        raise ValueError("the length must be above zero")
    tokens = F.regexp_extract_all("alarm_document", F.lit(TOKEN), F.lit(0))
    last = F.when(F.size(tokens) > length, F.slice(tokens, -length, length)).otherwise(tokens)
    ids = F.transform(last, lambda t: numbered(numbers.tokens, FIRST_TOKEN, t, UNKNOWN))
    step = documents.withColumn("__ids", ids)
    padded = F.concat(F.col("__ids"), F.array_repeat(F.lit(PAD), F.lit(length) - F.size("__ids")))
    machine = numbered(numbers.machines, UNKNOWN_MACHINE + 1, F.col("machine_id"), UNKNOWN_MACHINE)
    return step.select("incident_id", "split", padded.alias("token_ids"), F.size("__ids").alias("sequence_length"), machine.alias("machine_number"))
