"""Exact order statistics without gathering all values in one task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

MARGIN, ACCURACY, MOST_VALUES = 0.002, 10_000, 20_000


def checked_quantile(q: float) -> float:
    if not 0 < q < 1:
        raise ValueError("the quantile must lie between 0 and 1")
    return q


def upper_quantiles(df: DataFrame, columns: tuple[str, ...], q: float) -> dict[str, float] | None:
    """For each column the value at place ceil((n - 1) q) of its sorted values, from 0; None without rows.

    A sketch gives bounds that are sure to hold the place; see ``value_at``.
    """
    checked_quantile(q)
    bounds = [F.percentile_approx(c, [max(0.0, q - MARGIN), min(1.0, q + MARGIN)], ACCURACY).alias(c) for c in columns]
    first = df.agg(F.count(F.lit(1)).alias("n"), *bounds).first()
    if not first["n"]:
        return None
    places = {c: ceil((first["n"] - 1) * q) for c in columns}
    return {c: value_at(df, c, places[c], first[c][0], first[c][1]) for c in columns}


def value_at(df: DataFrame, column: str, place: int, low: float, high: float) -> float:
    """The value at ``place`` (from 0) of the sorted values of a column, which lies between ``low`` and ``high``.

    While more than MOST_VALUES different values lie between the bounds, quantiles of
    those rows bring them nearer; so no more than that go to the driver.
    """
    while True:
        inside = df.where(F.col(column).between(low, high))
        below, n, different = df.agg(F.count_if(F.col(column) < low), F.count_if(F.col(column).between(low, high)), F.approx_count_distinct(F.when(F.col(column).between(low, high), F.col(column)))).first()
        if different <= MOST_VALUES:
            break
        share = (place - below) / n
        low, high = inside.agg(F.percentile_approx(column, [max(0.0, share - MARGIN), min(1.0, share + MARGIN)], ACCURACY)).first()[0]
    seen = below
    for value, count in inside.groupBy(F.col(column).cast("double").alias("value")).count().orderBy("value").collect():
        seen += count
        if seen > place:
            return value
    raise ValueError("the place is not between the bounds")


#: Ranges of a group's values to an e-fold of their size, and ranges that an open one is cut into.
FINENESS, CUTS = 512, 4096


@dataclass(frozen=True)
class Place:
    """A place (from 0, a column over ``total``) among the sorted values of a metric, and the name of what stands there."""

    name: str
    metric: str
    at: Callable[[Column], Column]


def upper_place(q: float, metric: str, name: str) -> Place:
    checked_quantile(q)
    return Place(name, metric, lambda total: F.ceil((total - 1) * F.lit(q)))


def neighbours(q: float, metric: str, name: str) -> tuple[Place, Place]:
    """The places next to the quantile, as ``name``_low and ``name``_high."""
    exact = lambda total: (total - 1) * F.lit(float(q))
    return Place(f"{name}_low", metric, lambda total: F.floor(exact(total))), Place(f"{name}_high", metric, lambda total: F.ceil(exact(total)))


def interpolated(q: float, name: str) -> Column:
    """The quantile between its ``neighbours``, in proportion; over columns of them and ``total``."""
    exact, low, high = (F.col("total") - 1) * F.lit(float(q)), F.col(f"{name}_low"), F.col(f"{name}_high")
    return (low + (high - low) * (exact - F.floor(exact))).alias(name)


def hit(ranges: Column, place: Column) -> Column:
    """Of sorted ``ranges`` (number, n, low, high) the one that holds ``place``: its low, high and how many values are below it."""
    kind = "struct<low:double,high:double,skip:bigint>"
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(kind).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        here = (acc["seen"] <= place) & (place < acc["seen"] + x["n"])
        own = F.struct(x["low"].alias("low"), x["high"].alias("high"), acc["seen"].alias("skip"))
        return F.struct((acc["seen"] + x["n"]).alias("seen"), F.when(here, own).otherwise(acc["found"]).alias("found"))

    return F.aggregate(ranges, start, step)["found"]


def summed_ranges(values: DataFrame, keys: tuple[str, ...], number: Column) -> DataFrame:
    """``keys`` with total and the sorted ranges of their values: number, n, low and high. Rows are summed up where they are read."""
    ranges = values.groupBy(*keys, number.alias("number")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    return ranges.groupBy(*keys).agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("number", "n", "low", "high"))).alias("ranges"))


def values_at(df: DataFrame, keys: tuple[str, ...], places: tuple[Place, ...]) -> DataFrame:
    """``keys``, total (the rows of a group) and the exact value at each of ``places``, a row a group.

    Values are numbers, none null. They are counted in ranges whose numbers do not fall as values grow; the range that
    holds a place is cut again into CUTS, between its least and largest value, until it holds one value. So a
    group of any size goes through sums that are made where its rows are, an array of ranges (their number depends on how far
    values spread, not on how many there are), and joins with a row a group and place. ``df`` is read once
    a round, so it should be stored or cheap.
    """
    metrics = tuple(dict.fromkeys(p.metric for p in places))
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    values = df.select(*keys, pairs.alias("x")).select(*keys, "x.metric", "x.value")
    # both logarithm and floor never fall as values grow
    size = F.floor(F.signum("value") * F.log1p(F.abs("value") * 1e6) * FINENESS)
    first = summed_ranges(values, (*keys, "metric"), size)
    asked = F.array(*(F.struct(F.lit(p.metric).alias("metric"), F.lit(p.name).alias("name"), p.at(F.col("total")).cast("long").alias("place")) for p in places))
    rows = first.withColumn("p", F.explode(F.filter(asked, lambda x: x["metric"] == F.col("metric"))))
    found = rows.select(*keys, "metric", "total", "p.name", "p.place", hit(F.col("ranges"), F.col("p.place")).alias("x")).select(*keys, "metric", "total", "name", F.col("place") - F.col("x.skip"), "x.low", "x.high").toDF(*keys, "metric", "total", "name", "place", "low", "high")
    done = None
    while True:
        found = stored(found)
        done = found if done is None else done.where("low = high").unionByName(found)
        open_ = found.where("low < high")
        if open_.isEmpty():
            break
        # a group's open places are few; a value is counted once for each whose range it lies in
        inside = values.join(open_, [*keys, "metric"]).where(F.col("value").between(F.col("low"), F.col("high")))
        part = F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * CUTS)
        cut = summed_ranges(inside, (*keys, "metric", "name"), part).select(*keys, "metric", "name", "ranges")
        next_ = open_.select(*keys, "metric", "total", "name", "place").join(cut, [*keys, "metric", "name"])
        found = next_.withColumn("x", hit(F.col("ranges"), F.col("place"))).select(*keys, "metric", "total", "name", (F.col("place") - F.col("x.skip")).alias("place"), "x.low", "x.high")
    return done.groupBy(*keys).agg(F.max("total").alias("total"), *(F.max(F.when(F.col("name") == p.name, F.col("low"))).alias(p.name) for p in places))
