"""Queries over events and episodes, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import shared_folder, stored, stored_then_removed
from ..operators import baselines as B
from ..operators import episodes as E
from ..operators import ingest as I
from ..operators import profiles as P
from ..sources.events import read_alarm_csv, table_events, write_alarm_csv
from . import oracle_base as O

LEAST_EPISODES = 150
GAPS = (15.0, 30.0, 60.0)


def processed(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return I.processed_events(table_events(spark, sf_dir, dense))


def ready(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    """Processed events, stored: the rules of episodes read them once for the ends of blocks and once for the rows."""
    return stored(processed(spark, sf_dir, dense))


def csv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events written as a CSV log of several files in the shared folder and read back through its contract."""
    path = f"{shared_folder(spark).rstrip('/')}/csv-log-{uuid.uuid4().hex}"
    write_alarm_csv(table_events(spark, sf_dir), path)
    return stored_then_removed(read_alarm_csv(spark, path), path)


def episodes(spark: SparkSession, sf_dir: str, dense: bool = False) -> DataFrame:
    return E.summarize(ready(spark, sf_dir, dense))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(episodes(spark, sf_dir))
    return B.apply_flags(rows, B.fit_global(rows), B.fit_machines(rows, least=LEAST_EPISODES))


def overview(part: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.overview_tables(table_events(spark, sf_dir), episodes(spark, sf_dir))[part]

    return query


PROCESSED_SQL = "timestamp, alarm_code, machine_id, source_row, duplicate_group_size, is_exact_duplicate, previous_timestamp, gap_seconds, split"
ENDS_SQL = ", ".join(f"{f}(timestamp) FILTER (split = '{s}') AS {s}_{n}" for s in I.SPLITS for n, f in (("start", "min"), ("end", "max")))
BOUNDS_SQL = f"SELECT machine_id, {ENDS_SQL}, " + ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_events" for s in I.SPLITS) + " FROM proc GROUP BY machine_id"
QUALITY_SQL = """
, dup AS (SELECT count(*) AS n FROM ev GROUP BY timestamp, alarm_code, machine_id HAVING count(*) > 1),
back AS (SELECT us < lag(us) OVER (ORDER BY source_row) AS overall, us < lag(us) OVER (PARTITION BY machine_id ORDER BY source_row) AS own FROM ev)
SELECT (SELECT count(*) FROM dup) AS exact_duplicate_group_count, (SELECT coalesce(sum(n), 0)::BIGINT FROM dup) AS rows_in_duplicate_groups,
       (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM dup) AS duplicate_excess_row_count,
       (SELECT count(*) FILTER (overall) FROM back) AS global_time_reversal_count, (SELECT count(*) FILTER (own) FROM back) AS within_machine_time_reversal_count"""
MACHINES_SQL = """SELECT machine_id, count(*) AS event_count, count(*)::DOUBLE / sum(count(*)) OVER () AS event_share, count(DISTINCT alarm_code) AS alarm_code_count,
       min(timestamp) AS start_time, max(timestamp) AS end_time FROM ev GROUP BY machine_id"""
ALARMS_SQL = """SELECT alarm_code, n AS event_count, n::DOUBLE / sum(n) OVER () AS event_share,
       (sum(n) OVER (ORDER BY n DESC, alarm_code ROWS UNBOUNDED PRECEDING))::DOUBLE / sum(n) OVER () AS cumulative_share, machine_count
FROM (SELECT alarm_code, count(*) AS n, count(DISTINCT machine_id) AS machine_count FROM ev GROUP BY alarm_code)"""
MONTHS_SQL = """SELECT date_trunc('month', timestamp)::TIMESTAMP AS month_start, count(*) AS event_count, count(*)::DOUBLE / sum(count(*)) OVER () AS event_share,
       count(DISTINCT machine_id) AS machine_count, count(DISTINCT alarm_code) AS alarm_code_count FROM ev GROUP BY 1"""
GAPS_SQL = """SELECT t::DOUBLE AS threshold_minutes, count(*) FILTER (gap_seconds / 60 <= t) AS within_threshold_count,
       count(*) FILTER (gap_seconds / 60 <= t)::DOUBLE / count(gap_seconds) AS within_threshold_share,
       count(*) FILTER (gap_seconds / 60 > t) AS incident_break_count,
       count(DISTINCT machine_id) + count(*) FILTER (gap_seconds / 60 > t) AS estimated_incident_count
FROM proc CROSS JOIN (VALUES (1.0::DOUBLE), (5), (15), (30), (60)) v(t) GROUP BY t"""
SENSITIVITY_SQL = " UNION ALL ".join(
    f"""SELECT {g}::DOUBLE AS gap_minutes, count(*) AS incident_count, count(*) FILTER (event_count = 1) AS singleton_incident_count,
       count(*) FILTER (event_count = 1)::DOUBLE / count(*) AS singleton_incident_share, quantile_cont(event_count::DOUBLE, 0.5) AS median_event_count,
       quantile_cont(event_count::DOUBLE, 0.95) AS p95_event_count, quantile_cont(duration_seconds, 0.5) AS median_duration_seconds,
       quantile_cont(duration_seconds, 0.95) AS p95_duration_seconds, avg(distinct_alarm_count) AS mean_distinct_alarm_count FROM inc{int(g)}"""
    for g in GAPS
)
SENSITIVITY_BASE = ", ".join(f"{O.numbered(g, f'num{int(g)}')}, {O.summary(g, f'inc{int(g)}', f'num{int(g)}')}" for g in GAPS)
FLAG_SQL = ", ".join(["baseline_scope", "machine_train_incident_count", "baseline_train_incident_count", "baseline_quantile", *(c for m in O.METRICS for c in (f"{m}_threshold", f"is_high_{m}")), "upper_tail_flag_count", "upper_tail_flag_count > 0 AS is_upper_tail"])
RUNS_SQL = """, runs AS (
  SELECT *, sum(change) OVER (PARTITION BY incident_id ORDER BY event_position) - 1 AS run FROM (
    SELECT *, coalesce((lag(alarm_code) OVER (PARTITION BY incident_id ORDER BY event_position) <> alarm_code)::BIGINT, 1) AS change FROM mapped))
SELECT incident_id, run::BIGINT AS run, any_value(alarm_code) AS alarm_code, min(timestamp) AS run_start, max(timestamp) AS run_end, count(*) AS repeat_count FROM runs GROUP BY incident_id, run"""
WITH_FLAGS = f"WITH {O.episodes()}, {O.baselines(LEAST_EPISODES)}, {O.flags()}"

#: name -> (query, SQL)
LOG = {
    "load_events": (lambda s, d: table_events(s, d), f"WITH {O.events()} SELECT timestamp, alarm_code, machine_id, source_row FROM ev"),
    "load_events_csv": (csv_events, f"WITH {O.events()} SELECT timestamp, alarm_code, machine_id, row_number() OVER (ORDER BY source_row) - 1 AS source_row FROM ev"),
    "processed_events": (processed, f"WITH {O.processed()} SELECT {PROCESSED_SQL} FROM proc"),
    "processed_events_dense": (lambda s, d: processed(s, d, True), f"WITH {O.processed(True)} SELECT {PROCESSED_SQL} FROM proc"),
    "duplicate_groups": (lambda s, d: P.duplicate_groups(table_events(s, d, True)), f"WITH {O.events(True)} SELECT timestamp, alarm_code, machine_id, count(*) AS duplicate_group_size FROM ev GROUP BY ALL HAVING count(*) > 1"),
    "inter_event_gaps": (lambda s, d: I.add_gaps(table_events(s, d)).select("source_row", "machine_id", "previous_timestamp", "gap_seconds"), f"WITH {O.processed()} SELECT source_row, machine_id, previous_timestamp, gap_seconds FROM proc"),
    "chronological_split": (lambda s, d: I.assign_splits(table_events(s, d, True)).select("source_row", "machine_id", "timestamp", "split"), f"WITH {O.processed(True)} SELECT source_row, machine_id, timestamp, split FROM proc"),
    "split_boundaries": (lambda s, d: I.split_boundaries(processed(s, d)), f"WITH {O.processed()} {BOUNDS_SQL}"),
    "split_integrity": (lambda s, d: I.split_violations(processed(s, d, True)), f"WITH {O.processed(True)}, b AS ({BOUNDS_SQL}) SELECT * FROM b WHERE NOT coalesce(train_end < validation_start AND validation_end < test_start, false)"),
    "dataset_overview": (lambda s, d: P.dataset_overview(table_events(s, d)), f"WITH {O.events()} SELECT count(*) AS event_count, count(DISTINCT machine_id) AS machine_count, count(DISTINCT alarm_code) AS alarm_code_count, min(timestamp) AS start_time, max(timestamp) AS end_time FROM ev"),
    "data_quality": (lambda s, d: P.data_quality(table_events(s, d)), f"WITH {O.events()} {QUALITY_SQL}"),
    "data_quality_dense": (lambda s, d: P.data_quality(table_events(s, d, True)), f"WITH {O.events(True)} {QUALITY_SQL}"),
    "machine_profile": (lambda s, d: P.machine_profile(table_events(s, d)), f"WITH {O.events()} {MACHINES_SQL}"),
    "alarm_profile": (lambda s, d: P.alarm_profile(table_events(s, d)), f"WITH {O.events()} {ALARMS_SQL}"),
    "monthly_profile": (lambda s, d: P.monthly_profile(table_events(s, d)), f"WITH {O.events()} {MONTHS_SQL}"),
    "gap_threshold_profile": (lambda s, d: P.gap_threshold_profile(table_events(s, d), (1, 5, 15, 30, 60)), f"WITH {O.processed()} {GAPS_SQL}"),
    "incident_starts": (lambda s, d: E.mark_starts(ready(s, d)).select("source_row", "is_incident_start"), f"WITH {O.processed()}, {O.numbered()} SELECT source_row, is_start AS is_incident_start FROM num"),
    "incident_ids": (lambda s, d: E.identify_events(ready(s, d, True)).select("source_row", "machine_episode", "incident_id"), f"WITH {O.episodes(True)}, {O.MAPPING} SELECT source_row, machine_episode::BIGINT AS machine_episode, incident_id FROM mapped"),
    "incident_event_mapping": (lambda s, d: E.event_mapping(ready(s, d)), f"WITH {O.episodes()}, {O.MAPPING} SELECT incident_id, source_row, event_position FROM mapped"),
    "incident_summary": (episodes, f"WITH {O.episodes()} SELECT {O.SUMMARY} FROM inc"),
    "incident_summary_dense": (lambda s, d: episodes(s, d, True), f"WITH {O.episodes(True)} SELECT {O.SUMMARY} FROM inc"),
    "dominant_alarm": (lambda s, d: episodes(s, d, True).select("incident_id", "dominant_alarm_code"), f"WITH {O.episodes(True)} SELECT incident_id, dominant_alarm_code FROM inc"),
    "gap_sensitivity": (lambda s, d: E.sensitivity_profile(ready(s, d), GAPS), f"WITH {O.processed()}, {SENSITIVITY_BASE} {SENSITIVITY_SQL}"),
    "transition_view": (lambda s, d: E.transition_view(ready(s, d, True)), f"WITH {O.episodes(True)}, {O.MAPPING}{RUNS_SQL}"),
    "global_baseline": (lambda s, d: B.fit_global(stored(episodes(s, d))), f"WITH {O.episodes()}, {O.baselines(LEAST_EPISODES)} SELECT * FROM overall"),
    "machine_baselines": (lambda s, d: B.fit_machines(stored(episodes(s, d)), least=LEAST_EPISODES), f"WITH {O.episodes()}, {O.baselines(LEAST_EPISODES)} SELECT * FROM machines"),
    "incident_flags": (flagged, f"{WITH_FLAGS} SELECT {O.SUMMARY}, {FLAG_SQL} FROM flagged"),
    "split_upper_tail_share": (lambda s, d: B.upper_tail_shares(flagged(s, d)), f"{WITH_FLAGS} SELECT split, count(*) AS incident_count, count(*) FILTER (upper_tail_flag_count > 0) AS upper_tail_count, count(*) FILTER (upper_tail_flag_count > 0)::DOUBLE / count(*) AS upper_tail_share FROM flagged GROUP BY split"),
    "overview_totals": (overview("totals"), f"WITH {O.episodes()} SELECT count(*) AS event_count, count(DISTINCT machine_id) AS machine_count, count(DISTINCT alarm_code) AS alarm_code_count, min(timestamp) AS start_time, max(timestamp) AS end_time, (SELECT count(*) FROM inc) AS incident_count FROM ev"),
    "overview_months": (overview("months"), f"WITH {O.events()} SELECT date_trunc('month', timestamp)::TIMESTAMP AS month_start, count(*) AS event_count FROM ev GROUP BY 1"),
    "overview_top_alarms": (overview("top_alarms"), f"WITH {O.events()} SELECT alarm_code, count(*) AS event_count FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12"),
    "overview_machines": (overview("machines"), f"WITH {O.events()} SELECT machine_id, count(*) AS event_count FROM ev GROUP BY 1"),
    "overview_splits": (overview("splits"), f"WITH {O.episodes()} SELECT s.split, count(i.incident_id) AS incident_count FROM (VALUES ('train'), ('validation'), ('test')) s(split) LEFT JOIN inc i USING (split) GROUP BY 1"),
}
