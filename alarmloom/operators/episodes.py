"""Episodes: runs of a machine's events without a long gap, inside one split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import interpolated, neighbours, values_at
from ..functions.scalars import EPISODE_SOURCE, episode_id, micros, ratio, time_of
from ..functions.storage import stored
from .ingest import by_block, in_blocks

SUMMARY_COLUMNS = ("incident_id", "machine_id", "split", "incident_source", "is_ground_truth", "gap_minutes", "start_time", "end_time", "duration_seconds", "event_count", "distinct_alarm_count", "first_alarm_code", "last_alarm_code", "dominant_alarm_code", "duplicate_event_count")


def checked_gap(gap_minutes: float) -> float:
    if not 0 < gap_minutes < float("inf"):
        raise ValueError("the gap must be finite and above zero")
    return float(gap_minutes)


def opened(events: DataFrame, gaps: tuple[float, ...]) -> DataFrame:
    """``in_blocks`` with the event's place in the machine's log (from 1) and, for limit i of ``gaps``, start_i, episode_i (from 0) and opening_i.

    An episode starts with a machine's first event, a new split, or a gap above the limit (a gap of
    just the limit stays). Inside a block that is seen in place. A row a block tells
    how its first event differs from the block before and which episode is open at its end, and a
    window over those rows carries places, numbers and openings across blocks, so that neither
    a machine nor an episode is bound to one task.
    """
    limits = [checked_gap(g) * 60 for g in gaps]
    blocks = in_blocks(events).withColumn("row", F.row_number().over(by_block())).withColumn("new_split", ~F.lag("split").over(by_block()).eqNullSafe(F.col("split")))

    def long_gap(column: str, limit: float) -> Column:
        return F.coalesce(F.col(column) > limit, F.lit(False))

    inside = [(F.col("row") > 1) & (F.col("new_split") | long_gap("gap_seconds", limit)) for limit in limits]
    ends = blocks.groupBy("machine_id", "block").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("us", "source_row", "split", "gap_seconds"), "row").alias("first"),
        F.max_by("split", "row").alias("last_split"),
        *(F.max(F.when(s, F.struct("row", "us", "source_row"))).alias(f"last_{i}") for i, s in enumerate(inside)),
        *(F.count_if(s).alias(f"starts_{i}") for i, s in enumerate(inside)),
    )
    order = Window.partitionBy("machine_id").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.row_number().over(order) == 1) | ~F.lag("last_split").over(order).eqNullSafe(F.col("first.split"))
    placed = ends.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("cut", cut)
    placed = placed.withColumns({f"opens_{i}": F.col("cut") | long_gap("first.gap_seconds", limit) for i, limit in enumerate(limits)})

    def own(i: int) -> Column:
        last = F.col(f"last_{i}")
        late = F.struct(last["us"].alias("us"), last["source_row"].alias("source_row"), (F.col("before") + last["row"]).alias("place"))
        return F.when(last.isNotNull(), late).when(F.col(f"opens_{i}"), F.struct(F.col("first.us"), F.col("first.source_row"), (F.col("before") + 1).alias("place")))

    carried = placed.select(
        "machine_id",
        "block",
        "before",
        *(f"opens_{i}" for i in range(len(gaps))),
        *(F.last(own(i), ignorenulls=True).over(earlier).alias(f"held_{i}") for i in range(len(gaps))),
        *(F.coalesce(F.sum(F.col(f"starts_{i}") + F.col(f"opens_{i}").cast("long")).over(earlier), F.lit(0)).alias(f"numbers_{i}") for i in range(len(gaps))),
    )
    running = by_block().rowsBetween(Window.unboundedPreceding, 0)
    joined = blocks.join(carried, ["machine_id", "block"], "left").withColumn("place", F.coalesce("before", F.lit(0)) + F.col("row"))
    joined = joined.withColumns({f"start_{i}": F.when(F.col("row") > 1, s).otherwise(F.coalesce(f"opens_{i}", F.lit(True))) for i, s in enumerate(inside)})
    found = {}
    for i in range(len(gaps)):
        found[f"episode_{i}"] = F.coalesce(f"numbers_{i}", F.lit(0)) + F.sum(F.col(f"start_{i}").cast("long")).over(running) - 1
        found[f"opening_{i}"] = F.coalesce(F.last(F.when(F.col(f"start_{i}"), F.struct("us", "source_row", "place")), ignorenulls=True).over(running), F.col(f"held_{i}"))
    return joined.select(*events.columns, "us", "place", *(f"start_{i}" for i in range(len(gaps))), *(c.alias(n) for n, c in found.items()))


def mark_starts(events: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    """Adds is_incident_start."""
    return opened(events, (gap_minutes,)).select(*events.columns, F.col("start_0").alias("is_incident_start"))


def number_episodes(events: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    """Adds us, place, machine_episode (from 0 within the machine) and opening, which names the episode."""
    marks = (F.col("start_0").alias("is_incident_start"), F.col("episode_0").alias("machine_episode"), F.col("opening_0").alias("opening"))
    return opened(events, (gap_minutes,)).select(*events.columns, "us", "place", *marks)


def identify_events(events: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    """Each event with its episode's id and its place in it, from 0."""
    key = episode_id(F.col("machine_id"), F.col("split"), F.col("opening.us"), F.col("opening.source_row"), gap_minutes)
    position = (F.col("place") - F.col("opening.place")).cast("long")
    return number_episodes(events, gap_minutes).select(*events.columns, "is_incident_start", "machine_episode", key.alias("incident_id"), position.alias("event_position"))


def event_mapping(events: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    return identify_events(events, gap_minutes).select("incident_id", "source_row", "event_position")


def summarize(events: DataFrame, gap_minutes: float = 30.0) -> DataFrame:
    """One row an episode; its parts in several blocks are summed up before they are shuffled."""
    order = F.struct("us", "source_row")
    grouped = number_episodes(events, gap_minutes).groupBy("machine_id", "machine_episode").agg(
        F.first("split").alias("split"),
        F.min(order).alias("opening"),
        F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("event_count"),
        F.size(F.collect_set("alarm_code")).cast("long").alias("distinct_alarm_count"),
        F.min_by("alarm_code", order).alias("first_alarm_code"),
        F.max_by("alarm_code", order).alias("last_alarm_code"),
        F.expr("mode() WITHIN GROUP (ORDER BY alarm_code)").alias("dominant_alarm_code"),
        F.count_if("is_exact_duplicate").alias("duplicate_event_count"),
    )
    start = F.col("opening.us")
    return grouped.select(
        episode_id(F.col("machine_id"), F.col("split"), start, F.col("opening.source_row"), gap_minutes).alias("incident_id"),
        "machine_id",
        "split",
        F.lit(EPISODE_SOURCE).alias("incident_source"),
        F.lit(False).alias("is_ground_truth"),
        F.lit(float(gap_minutes)).alias("gap_minutes"),
        time_of(start).alias("start_time"),
        time_of("last_us").alias("end_time"),
        ((F.col("last_us") - start) / F.lit(1e6)).alias("duration_seconds"),
        *SUMMARY_COLUMNS[9:],
    )


def episode_sizes(events: DataFrame, gaps: tuple[float, ...]) -> DataFrame:
    """(gap_minutes, event_count, duration_seconds, distinct_alarm_count) of the episodes of each gap limit, from one sort of the events.

    The events are numbered for all limits side by side; each is then counted once a limit.
    """
    numbers = F.array(*(F.struct(F.lit(float(g)).alias("gap_minutes"), F.col(f"episode_{i}").alias("episode")) for i, g in enumerate(gaps)))
    each = opened(events, gaps).select("machine_id", "us", "alarm_code", F.explode(numbers).alias("x"))
    sizes = each.groupBy("x.gap_minutes", "machine_id", "x.episode").agg(F.count(F.lit(1)).alias("event_count"), F.min("us").alias("first"), F.max("us").alias("last"), F.size(F.collect_set("alarm_code")).cast("long").alias("distinct_alarm_count"))
    return sizes.select("gap_minutes", "event_count", ((F.col("last") - F.col("first")) / F.lit(1e6)).alias("duration_seconds"), "distinct_alarm_count")


def sensitivity_profile(events: DataFrame, gaps: tuple[float, ...] = (15.0, 30.0, 60.0)) -> DataFrame:
    """Episode counts and sizes for each gap limit; quantiles interpolate."""
    sizes = stored(episode_sizes(events, gaps))
    wanted = [(q, m, f"{n}_{m}") for m in ("event_count", "duration_seconds") for n, q in (("median", 0.5), ("p95", 0.95))]
    places = values_at(sizes, ("gap_minutes",), tuple(p for w in wanted for p in neighbours(*w)))
    sums = sizes.groupBy("gap_minutes").agg(
        F.count(F.lit(1)).alias("incident_count"), F.count_if(F.col("event_count") == 1).alias("singleton_incident_count"), F.sum("distinct_alarm_count").alias("code_total")
    )
    return sums.join(places, "gap_minutes").select(
        "gap_minutes",
        "incident_count",
        "singleton_incident_count",
        ratio("singleton_incident_count", "incident_count").alias("singleton_incident_share"),
        *(interpolated(q, name) for q, _, name in wanted),
        ratio("code_total", "incident_count").alias("mean_distinct_alarm_count"),
    )


def with_runs(identified: DataFrame) -> DataFrame:
    """Adds run: the number, from 0, of the event's run of one code within its episode.

    A run starts with an episode or another code. Starts are numbered through the machine's log, in blocks; a row a block
    carries the last code, the starts so far and the number of the start that opened the episode, so
    that no episode, however long, is walked in one task.
    """
    starts, code = F.col("is_incident_start"), F.col("alarm_code")
    blocks = in_blocks(identified).withColumn("row", F.row_number().over(by_block())).withColumn("code_before", F.lag("alarm_code").over(by_block()))
    running = by_block().rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("row") > 1) & (starts | F.coalesce(F.col("code_before") != code, F.lit(True)))
    blocks = blocks.withColumn("own", F.sum(inside.cast("long")).over(running))
    ends = blocks.groupBy("machine_id", "block").agg(
        F.min_by(F.struct("alarm_code", "is_incident_start"), "row").alias("first"),
        F.max_by(F.struct("alarm_code", "own"), "row").alias("last"),
        F.max(F.when(starts & (F.col("row") > 1), F.struct("row", "own"))).alias("opening"),
    )
    order = Window.partitionBy("machine_id").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.col("first.is_incident_start") | F.coalesce(F.lag("last").over(order)["alarm_code"] != F.col("first.alarm_code"), F.lit(True))
    placed = ends.withColumn("opens", opens.cast("long")).withColumn("before", F.coalesce(F.sum(F.col("last.own") + F.col("opens")).over(earlier), F.lit(0)))
    base = F.col("before") + F.col("opens")
    latest = F.when(F.col("opening").isNotNull(), base + F.col("opening.own")).when(F.col("first.is_incident_start"), base)
    carried = placed.select("machine_id", "block", base.alias("base"), F.last(latest, ignorenulls=True).over(earlier).alias("held"))
    numbered = blocks.join(carried, ["machine_id", "block"], "left").withColumn("number", F.coalesce("base", F.lit(1)) + F.col("own"))
    opening = F.coalesce(F.last(F.when(starts, F.col("number")), ignorenulls=True).over(running), F.col("held"))
    return numbered.select(*identified.columns, (F.col("number") - opening).alias("run"))


def transition_view(events: DataFrame) -> DataFrame:
    """Runs of one code within an episode: where each starts and ends and how often the code repeats."""
    identified = events if "event_position" in events.columns else stored(identify_events(events))
    return with_runs(identified).groupBy("incident_id", "run").agg(
        F.first("alarm_code").alias("alarm_code"), F.min("timestamp").alias("run_start"), F.max("timestamp").alias("run_end"), F.count(F.lit(1)).alias("repeat_count")
    )
