"""Common parts of the SQL that states what the queries return."""

from __future__ import annotations


def events(dense: bool = False) -> str:
    time = "date_trunc('hour', ts)::TIMESTAMP" if dense else "ts"
    code = "event_type" if dense else "json_extract_string(props, '$.k')"
    return f"ev AS (SELECT event_id AS source_row, {time} AS timestamp, (user_id % 20)::VARCHAR AS machine_id, {code} AS alarm_code, epoch_us({time}) AS us FROM events)"


def processed(dense: bool = False) -> str:
    return f"""{events(dense)},
gapped AS (
  SELECT *, count(*) OVER (PARTITION BY us, alarm_code, machine_id) AS dup,
         lag(us) OVER w AS previous_us, lag(timestamp) OVER w AS previous_timestamp,
         dense_rank() OVER (PARTITION BY machine_id ORDER BY us) - 1 AS place
  FROM ev WINDOW w AS (PARTITION BY machine_id ORDER BY us, source_row)
), counted AS (
  SELECT *, max(place) OVER (PARTITION BY machine_id) + 1 AS times FROM gapped
), proc AS (
  SELECT timestamp, alarm_code, machine_id, source_row, us, dup AS duplicate_group_size, dup > 1 AS is_exact_duplicate,
         previous_timestamp, (us - previous_us) / 1e6::DOUBLE AS gap_seconds,
         CASE WHEN place < floor(times::DOUBLE * 0.7::DOUBLE) THEN 'train'
              WHEN place < floor(times::DOUBLE * (0.7::DOUBLE + 0.15::DOUBLE)) THEN 'validation' ELSE 'test' END AS split
  FROM counted
)"""


def numbered(gap: float = 30, name: str = "num", source: str = "proc") -> str:
    return f"""{name} AS (
  SELECT *, sum(is_start::INTEGER) OVER (PARTITION BY machine_id ORDER BY us, source_row) - 1 AS machine_episode FROM (
    SELECT *, lag(split) OVER w IS NULL OR lag(split) OVER w <> split OR coalesce(gap_seconds > {gap * 60}, false) AS is_start
    FROM {source} WINDOW w AS (PARTITION BY machine_id ORDER BY us, source_row)))"""


def episode_key(gap: float = 30) -> str:
    return (
        "'inc_' || substr(sha256('{\"first_source_row\":' || first_row || ',\"gap_minutes\":\"" + format(float(gap), ".12g") + "\",\"incident_source\":\"time_gap_heuristic\",\"machine_id\":\"' || machine_id || "
        "'\",\"schema_version\":1,\"split\":\"' || split || '\",\"start_time\":\"' || strftime(start_time, '%Y-%m-%dT%H:%M:%S.%f') || '\"}'), 1, 16)"
    )


def summary(gap: float = 30, name: str = "inc", source: str = "num") -> str:
    return f"""{name}_codes AS (
  SELECT machine_id, machine_episode, arg_min(alarm_code, (-n, alarm_code)) AS dominant_alarm_code FROM (
    SELECT machine_id, machine_episode, alarm_code, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY ALL
), {name}_raw AS (
  SELECT machine_id, machine_episode, any_value(split) AS split, min(timestamp) AS start_time, max(timestamp) AS end_time,
         arg_min(source_row, (us, source_row)) AS first_row, max(us) AS end_us, min(us) AS start_us, count(*) AS event_count,
         count(DISTINCT alarm_code) AS distinct_alarm_count, arg_min(alarm_code, (us, source_row)) AS first_alarm_code,
         arg_max(alarm_code, (us, source_row)) AS last_alarm_code, count(*) FILTER (is_exact_duplicate) AS duplicate_event_count
  FROM {source} GROUP BY machine_id, machine_episode
), {name} AS (
  SELECT {episode_key(gap)} AS incident_id, r.*, dominant_alarm_code, (end_us - start_us) / 1e6::DOUBLE AS duration_seconds
  FROM {name}_raw r JOIN {name}_codes USING (machine_id, machine_episode)
)"""


def episodes(dense: bool = False, gap: float = 30) -> str:
    return f"{processed(dense)}, {numbered(gap)}, {summary(gap)}"


SUMMARY = f"incident_id, machine_id, split, 'time_gap_heuristic' AS incident_source, false AS is_ground_truth, 30.0::DOUBLE AS gap_minutes, start_time, end_time, duration_seconds, event_count, distinct_alarm_count, first_alarm_code, last_alarm_code, dominant_alarm_code, duplicate_event_count"

MAPPING = """mapped AS (
  SELECT i.incident_id, n.*, row_number() OVER (PARTITION BY n.machine_id, n.machine_episode ORDER BY n.us, n.source_row) - 1 AS event_position
  FROM num n JOIN inc i USING (machine_id, machine_episode))"""


def higher(column: str, q: float = 0.95) -> str:
    """Sorted value at place ceil((n - 1) q)."""
    return f"list_sort(list({column}))[ceil((count(*) - 1) * {q}::DOUBLE)::BIGINT + 1]::DOUBLE"


METRICS = ("event_count", "duration_seconds", "distinct_alarm_count")


def baselines(least: int) -> str:
    columns = ", ".join(f"{higher(m)} AS {m}_threshold" for m in METRICS)
    return f"""overall AS (SELECT 0.95::DOUBLE AS quantile, 'train' AS fit_split, count(*) AS incident_count, {columns} FROM inc WHERE split = 'train'),
machines AS (SELECT machine_id, 0.95::DOUBLE AS quantile, 'train' AS fit_split, count(*) AS incident_count, {least}::BIGINT AS minimum_incident_count,
  count(*) >= {least} AS has_sufficient_support, {columns} FROM inc WHERE split = 'train' GROUP BY machine_id)"""


def flags() -> str:
    columns = []
    for m in METRICS:
        t = f"(CASE WHEN m.has_sufficient_support THEN m.{m}_threshold ELSE o.{m}_threshold END)"
        columns += [f"{t} AS {m}_threshold", f"i.{m} > {t} AS is_high_{m}"]
    return f"""flagged_raw AS (
  SELECT i.*, CASE WHEN m.has_sufficient_support THEN 'machine' ELSE 'global_fallback' END AS baseline_scope,
         coalesce(m.incident_count, 0)::BIGINT AS machine_train_incident_count,
         CASE WHEN m.has_sufficient_support THEN m.incident_count ELSE o.incident_count END AS baseline_train_incident_count,
         o.quantile AS baseline_quantile, {", ".join(columns)}
  FROM inc i CROSS JOIN overall o LEFT JOIN machines m USING (machine_id)
), flagged AS (
  SELECT *, (is_high_event_count::BIGINT + is_high_duration_seconds::BIGINT + is_high_distinct_alarm_count::BIGINT) AS upper_tail_flag_count FROM flagged_raw
)"""
