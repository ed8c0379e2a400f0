"""Counts of the codes that follow an episode, kept up while the log streams in.

The batch model counts, for a machine and the last code of an episode, the episodes whose outcome is complete and the
codes that follow them within the horizon. Here each machine's state holds the moments that still wait for
the watermark, its open episode, the episodes whose horizon is not over, and the counts. Event-time timers take waiting moments in
their order once the watermark has passed them, so files in any order within the lateness give the counts of the batch rule.

Each call of the state is a round trip to the JVM. So events of one moment wait as one entry (their codes, and the last of them), the
moments of SLOT_US as one value, and a timer writes a count once, however often it changed.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalars import horizon_micros

#: Microseconds whose waiting moments are kept as one value of the state.
SLOT_US = 600_000_000
COUNTS = "machine_id string, last_alarm_code string, alarm_code string, hits long, samples long"


def frame(rows: list[tuple]) -> pd.DataFrame:
    """Plain objects, which Arrow takes into whatever types COUNTS names."""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COUNTS.split(", ")], dtype=object)


def add(moments: dict[int, tuple], us: int, row: int, code: str, codes) -> None:
    """Takes events of one moment in: their codes, and the code of the last row among them."""
    if us not in moments:
        moments[us] = (row, code, set(codes))
        return
    last, last_code, known = moments[us]
    known.update(codes)
    if (row, code) > (last, last_code):
        moments[us] = (row, code, known)


def text_of(moments: dict[int, tuple]) -> str:
    return json.dumps([(us, row, code, sorted(codes)) for us, (row, code, codes) in moments.items()])


def moments_of(text: str) -> list[list]:
    return json.loads(text)


def added(state, key: tuple, n: int) -> int:
    """A count of the state, raised by ``n``."""
    total = n + (state.getValue(key)[0] if state.containsKey(key) else 0)
    state.updateValue(key, (total,))
    return total


class TransitionCounter(StatefulProcessor):
    """State of one machine. A row comes out when a count changes, with its new value; a row without a code has the samples alone."""

    def __init__(self, gap_us: int, horizon_us: int):
        self.gap_us, self.horizon_us = gap_us, horizon_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting_slots", "slot long", "moments string")
        self.open = handle.getValueState("open", "end_us long, alarm_code string")
        self.pending = handle.getMapState("pending_codes", "end_us long", "last_alarm_code string, codes string")
        self.samples = handle.getMapState("samples", "last_alarm_code string", "n long")
        self.hits = handle.getMapState("hits", "last_alarm_code string, alarm_code string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slots: dict[int, dict] = {}
        for part in rows:
            for us, row, code in zip(part["us"].tolist(), part["source_row"].tolist(), part["alarm_code"].tolist()):
                if code is not None:
                    add(slots.setdefault(us // SLOT_US, {}), us, row, code, (code,))
        for slot, moments in slots.items():
            if self.waiting.containsKey((slot,)):
                for us, row, code, codes in moments_of(self.waiting.getValue((slot,))[0]):
                    add(moments, us, row, code, codes)
            self.waiting.updateValue((slot,), (text_of(moments),))
        if slots:
            self.handle.registerTimer(max(slots[max(slots)]) // 1000 + 1)
        yield frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.open.get() if self.open.exists() else None
        pending = {end: (last, set(json.loads(codes))) for (end,), (last, codes) in self.pending.iterator()}
        before, samples, hits, newest = set(pending), Counter(), Counter(), None

        def count(end: int) -> None:
            last, codes = pending.pop(end)
            samples[last] += 1
            hits.update((last, code) for code in codes)

        # only times are held of all slots; their moments are read slot by slot
        for slot in sorted(slot for (slot,) in self.waiting.keys() if slot * SLOT_US <= passed):
            due, later = [], {}
            for us, row, code, codes in moments_of(self.waiting.getValue((slot,))[0]):
                if us <= passed:
                    due.append((us, code, codes))
                else:
                    add(later, us, row, code, codes)
            for us, code, codes in sorted(due):
                if held and us - held[0] > self.gap_us:
                    pending[held[0]] = (held[1], set())
                for end in [end for end in pending if end + self.horizon_us < us]:
                    count(end)
                for _, known in pending.values():
                    known.update(codes)
                held = newest = (us, code)
            if later:
                self.waiting.updateValue((slot,), (text_of(later),))
            else:
                self.waiting.removeKey((slot,))
        if newest:  # nothing at or before this time can still come
            for end in [end for end in pending if end + self.horizon_us <= newest[0]]:
                count(end)
            self.open.update(held)
        for end in before - set(pending):
            self.pending.removeKey((end,))
        for end, (last, codes) in pending.items():
            self.pending.updateValue((end,), (last, json.dumps(sorted(codes))))
        totals = {last: added(self.samples, (last,), n) for last, n in samples.items()}
        rows = [(key[0], last, None, 0, n) for last, n in totals.items()]
        rows += [(key[0], *pair, added(self.hits, pair, n), totals[pair[0]]) for pair, n in hits.items()]
        yield frame(sorted(rows, key=repr))

    def close(self) -> None:
        pass


def transition_changes(events: DataFrame, gap_minutes: float = 30.0, hours: float = 6.0, lateness: str = "1 hour") -> DataFrame:
    """Changes of counts (COUNTS) from a stream of timestamp, machine_id, source_row and alarm_code of one split.

    Rows later than ``lateness`` behind the newest are dropped. A row whose code is null moves the watermark and counts nothing, so one
    at the end of a log lets the last events through.
    """
    timed = events.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", lateness)
    rows = timed.select(F.coalesce("machine_id", F.lit("")).alias("machine_id"), F.unix_micros("event_time").alias("us"), "source_row", "alarm_code", "event_time")
    counter = TransitionCounter(round(gap_minutes * 60_000_000), horizon_micros(hours))
    return rows.groupBy("machine_id").transformWithStateInPandas(counter, outputStructType=COUNTS, outputMode="Append", timeMode="EventTime")


def write_transition_changes(events: DataFrame, path: str, checkpoint: str, gap_minutes: float = 30.0, hours: float = 6.0, lateness: str = "1 hour"):
    """Starts a query that appends changes to Parquet, from what is there to read; started again with the same checkpoint it goes on where it stopped."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    changes = transition_changes(events, gap_minutes, hours, lateness)
    return changes.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(changes: DataFrame) -> DataFrame:
    """(machine_id, last_alarm_code, alarm_code, hits, samples) of the codes that follow some episode, from all changes so far; counts only grow."""
    samples = changes.groupBy("machine_id", "last_alarm_code").agg(F.max("samples").alias("samples"))
    hits = changes.where(F.col("alarm_code").isNotNull()).groupBy("machine_id", "last_alarm_code", "alarm_code").agg(F.max("hits").alias("hits"))
    return hits.join(samples, ["machine_id", "last_alarm_code"])
