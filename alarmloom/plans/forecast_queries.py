"""Queries over forecasts, investigation and samples, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import shared_folder, stored, stored_then_removed
from ..operators import forecasting as Y
from ..operators import investigation as V
from ..operators import samples as S
from ..operators import sequences as Q
from ..operators import windows as W
from ..operators.episodes import event_mapping
from ..sources.events import table_events
from ..streaming.transitions import COUNTS
from . import oracle_base as O
from .log_queries import WITH_FLAGS, flagged, processed
from .retrieval_queries import DOCUMENTS, FEATURES, Inputs, future, joined_arrays, rounded, similarity
from .sample_job import create_samples, parameter_grid, read_samples, write_samples
from .settings import Forecasting

HOURS, SPLIT, K = 6.0, "test", 5
LEAST_MACHINE, LEAST_TRANSITION, RARE_MOST, COMMON_LEAST = 200, 20, 49, 500
MODELS = (Y.GLOBAL, Y.MACHINE, Y.TRANSITION)
LEARNED = (Y.LOGISTIC, Y.LOGISTIC_BALANCED, Y.RECURRENT, Y.RECURRENT_BALANCED)


class Forecast:
    """Labels with the last code of each episode, their vocabulary and encoding; from the dense log, whose states have many samples."""

    def __init__(self, spark: SparkSession, sf_dir: str, dense: bool = True):
        self.inputs = Inputs(spark, sf_dir, dense)
        labels = W.forecast_labels(self.inputs.episodes, self.inputs.events, HOURS)
        last = self.inputs.episodes.select("incident_id", F.col("last_alarm_code"))
        self.labels = stored(Y.with_context(labels, last))
        self.vocabulary = Y.fit_vocabulary(self.labels)
        self.codes = stored(Y.encoded(self.labels, self.vocabulary))

    def groups(self) -> DataFrame:
        return Y.support_groups(Y.support_profile(self.labels), RARE_MOST, COMMON_LEAST)

    def scores(self, model: str) -> DataFrame:
        """Scores of a learned model, one of its four forms."""
        from ..operators.linear import score_linear
        from ..operators.recurrent import score_gru

        if model in (Y.RECURRENT, Y.RECURRENT_BALANCED):
            return score_gru(self.inputs.documents, self.labels, mode="none" if model == Y.RECURRENT else "balanced_capped")
        return score_linear(self.inputs.episodes, self.inputs.documents, self.labels, class_weight="none" if model == Y.LOGISTIC else "balanced")

    def predicted(self, model: str = Y.TRANSITION) -> DataFrame:
        if model in LEARNED:
            return stored(Y.predict_scored(self.labels, self.scores(model), K))
        return stored(Y.predict(self.labels, model, K, LEAST_MACHINE, LEAST_TRANSITION))

    def per_label(self, model: str = Y.TRANSITION, split: str = SPLIT, predicted: DataFrame | None = None) -> DataFrame:
        return Y.label_metrics(self.labels, self.codes, predicted or self.predicted(model), self.vocabulary, split)

    def per_query(self, model: str = Y.TRANSITION, split: str = SPLIT, predicted: DataFrame | None = None) -> DataFrame:
        return Y.query_metrics(self.labels, self.codes, predicted or self.predicted(model), split, K, model)

    def per_split(self, models: tuple[str, ...], splits: tuple[str, ...]) -> DataFrame:
        """One row a model and split; each model predicts once."""
        parts = []
        for model in models:
            predicted = self.predicted(model)
            parts += [Y.split_metrics(self.labels, self.per_query(model, s, predicted), self.per_label(model, s, predicted), s, model, K) for s in splits]
        return reduce(DataFrame.unionByName, parts)


def labels_query(dense: bool):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = Forecast(spark, sf_dir, dense).labels.drop("last_alarm_code")
        counts = F.array_join(F.transform("future_alarm_counts", lambda x: F.concat_ws(":", x["alarm_code"], x["n"].cast("string"))), " ")
        return joined_arrays(rows.withColumn("future_alarm_counts", counts))

    return query


def model_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = stored(Forecast(spark, sf_dir).per_split(MODELS, ("validation",)))
    Y.check_selection(metrics)
    return rounded(Y.select_model(metrics, 0.01))


def selection_of_seven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation measures of all seven models, and which of them is selected."""
    metrics = stored(Forecast(spark, sf_dir).per_split(MODELS + LEARNED, ("validation",)))
    Y.check_selection(metrics)
    chosen = Y.select_model(metrics, 0.01).select("model_version", F.lit(True).alias("selected"))  # one row
    return rounded(metrics.join(chosen, "model_version", "left").withColumn("selected", F.coalesce("selected", F.lit(False))))


def all_split_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(Forecast(spark, sf_dir).per_split(MODELS, ("validation", SPLIT)))


def online(spark: SparkSession, sf_dir: str) -> DataFrame:
    forecast = Forecast(spark, sf_dir)
    return rounded(Y.predict_online(forecast.labels, forecast.labels.where(F.col("split") == SPLIT), K, HOURS, LEAST_MACHINE, LEAST_TRANSITION))


# ------------------------------------------------------------------ SQL


def labels_cte(dense: bool = True) -> str:
    return f"""{O.episodes(dense)}, {future(HOURS, 'machine_id, split')},
lab AS (SELECT incident_id, machine_id, split, last_alarm_code, end_time, out_us, last_us, is_complete, events, codes, counts FROM fut),
trn AS (SELECT * FROM lab WHERE split = 'train' AND is_complete),
voc AS (SELECT alarm_code, count(*) AS support FROM (SELECT unnest(codes) AS alarm_code FROM trn) GROUP BY 1),
flat AS (SELECT p.incident_id, p.alarm_code, p.n, v.alarm_code IS NOT NULL AS known FROM fut_pairs p LEFT JOIN voc v USING (alarm_code)),
enc AS (SELECT l.*, coalesce(f.known_codes, []) AS known_codes, coalesce(f.unknown_codes, []) AS unknown_codes, coalesce(f.unknown_events, 0)::BIGINT AS unknown_event_count FROM lab l LEFT JOIN (
  SELECT incident_id, list(alarm_code ORDER BY alarm_code) FILTER (known) AS known_codes, list(alarm_code ORDER BY alarm_code) FILTER (NOT known) AS unknown_codes, sum(n) FILTER (NOT known) AS unknown_events FROM flat GROUP BY 1) f USING (incident_id))"""


def labels_sql(dense: bool) -> str:
    return f"""WITH {labels_cte(dense)} SELECT incident_id, machine_id, split, end_time AS prediction_time, make_timestamp(out_us) AS forecast_end_time, make_timestamp(last_us) AS outcome_observed_through, is_complete AS outcome_is_complete,
  {HOURS}::DOUBLE AS forecast_horizon_hours, events AS future_event_count, len(codes)::BIGINT AS distinct_future_alarm_count, array_to_string(codes, ' ') AS future_alarm_codes, counts AS future_alarm_counts, len(codes) > 0 AS has_future_alarms FROM lab"""


BASE = f"WITH {labels_cte()}"
SUPPORT = "sup AS (SELECT row_number() OVER (ORDER BY support DESC, alarm_code)::INTEGER AS support_rank, alarm_code, support AS train_sample_support, support::DOUBLE / (SELECT count(*) FROM trn) AS train_sample_share FROM voc)"
GROUPED = f"{SUPPORT}, grp AS (SELECT *, CASE WHEN train_sample_support <= {RARE_MOST} THEN 'rare' WHEN train_sample_support >= {COMMON_LEAST} THEN 'common' ELSE 'medium' END AS support_group FROM sup)"
EVERY_GROUP = "(VALUES ('rare'), ('medium'), ('common')) g(support_group)"


def frequency(name: str, keys: str) -> str:
    on = " AND ".join(["h.alarm_code = v.alarm_code", *(f"h.{k.strip()} = s.{k.strip()}" for k in keys.split(",") if k.strip())])
    cols, comma = keys, ", " if keys else ""
    picked = ", ".join(f"s.{k.strip()}" for k in keys.split(",") if k.strip())
    return f"""{name} AS (SELECT {picked}{comma}s.samples, v.alarm_code, coalesce(h.hits, 0)::DOUBLE / s.samples AS score FROM (SELECT {cols}{comma}count(*) AS samples FROM trn {'GROUP BY ALL' if keys else ''}) s CROSS JOIN voc v
  LEFT JOIN (SELECT {cols}{comma}alarm_code, count(*) AS hits FROM (SELECT {cols}{comma}unnest(codes) AS alarm_code FROM trn) GROUP BY ALL) h ON {on})"""


FREQUENCIES = ", ".join((frequency("fglobal", ""), frequency("fmachine", "machine_id"), frequency("fstate", "machine_id, last_alarm_code")))
SCOPES = f"""ms AS (SELECT machine_id, count(*) AS machine_samples FROM trn GROUP BY 1), ss AS (SELECT machine_id, last_alarm_code, count(*) AS state_samples FROM trn GROUP BY ALL),
sc AS (SELECT e.*, coalesce(machine_samples, 0) AS machine_samples, coalesce(state_samples, 0) AS state_samples, CASE WHEN state_samples >= {LEAST_TRANSITION} THEN 'transition' WHEN machine_samples >= {LEAST_MACHINE} THEN 'machine_fallback' ELSE 'global_fallback' END AS scope,
  CASE WHEN machine_samples >= {LEAST_MACHINE} THEN 'machine' ELSE 'global_fallback' END AS machine_scope FROM enc e LEFT JOIN ms USING (machine_id) LEFT JOIN ss USING (machine_id, last_alarm_code))"""


def predictions(model: str, name: str) -> str:
    order = "row_number() OVER (PARTITION BY incident_id ORDER BY score DESC, alarm_code)"
    machine = {Y.TRANSITION: "scope = 'machine_fallback'", Y.MACHINE: "machine_scope = 'machine'", Y.GLOBAL: "false"}[model]
    overall = {Y.TRANSITION: "scope = 'global_fallback'", Y.MACHINE: "machine_scope = 'global_fallback'", Y.GLOBAL: "true"}[model]
    state = "scope = 'transition'" if model == Y.TRANSITION else "false"
    return f"""{name} AS (SELECT * FROM (SELECT *, {order} AS rank FROM (
  SELECT incident_id, split, is_complete, scope, alarm_code, score FROM sc JOIN fstate USING (machine_id, last_alarm_code) WHERE {state}
  UNION ALL SELECT incident_id, split, is_complete, scope, alarm_code, score FROM sc JOIN fmachine USING (machine_id) WHERE {machine}
  UNION ALL SELECT incident_id, split, is_complete, scope, alarm_code, score FROM sc CROSS JOIN fglobal WHERE {overall})) WHERE rank <= {K})"""


def measures(model: str, split: str, tag: str) -> str:
    return f"""{predictions(model, f'pr{tag}')},
qm{tag} AS (SELECT s.incident_id, s.split, '{model}' AS model_version, {K} AS top_k, len(known_codes)::BIGINT AS known_label_count, len(unknown_codes)::BIGINT AS unknown_alarm_code_count, s.unknown_event_count AS unknown_alarm_event_count,
  count(p.alarm_code) FILTER (list_contains(known_codes, p.alarm_code)) AS true_positive_count, count(p.alarm_code) AS named
  FROM sc s LEFT JOIN pr{tag} p USING (incident_id) WHERE s.split = '{split}' AND s.is_complete GROUP BY s.incident_id, s.split, known_codes, unknown_codes, s.unknown_event_count),
q{tag} AS (SELECT * EXCLUDE (named), true_positive_count > 0 AS hit_at_k, true_positive_count::DOUBLE / nullif(named, 0) AS precision_at_k, true_positive_count::DOUBLE / nullif(known_label_count, 0) AS recall_at_k FROM qm{tag}),
tr{tag} AS (SELECT incident_id, unnest(known_codes) AS alarm_code FROM sc WHERE split = '{split}' AND is_complete),
pn{tag} AS (SELECT incident_id, alarm_code FROM pr{tag} WHERE split = '{split}' AND is_complete),
lc{tag} AS (SELECT v.alarm_code, (SELECT count(*) FROM tr{tag} t WHERE t.alarm_code = v.alarm_code) AS s, (SELECT count(*) FROM pn{tag} p WHERE p.alarm_code = v.alarm_code) AS p,
  (SELECT count(*) FROM tr{tag} t JOIN pn{tag} p USING (incident_id, alarm_code) WHERE t.alarm_code = v.alarm_code) AS h FROM voc v),
l{tag} AS (SELECT alarm_code, s AS evaluation_support, p AS predicted_positive_count, h AS true_positive_count, coalesce(h::DOUBLE / nullif(p, 0), 0) AS precision_at_k, coalesce(h::DOUBLE / nullif(s, 0), 0) AS recall_at_k,
  coalesce(2 * coalesce(h::DOUBLE / nullif(p, 0), 0) * coalesce(h::DOUBLE / nullif(s, 0), 0) / nullif(coalesce(h::DOUBLE / nullif(p, 0), 0) + coalesce(h::DOUBLE / nullif(s, 0), 0), 0), 0) AS f1_at_k FROM lc{tag}),
s{tag} AS (SELECT '{split}' AS split, '{model}' AS model_version, {K} AS top_k, (SELECT count(*) FROM lab WHERE split = '{split}') AS episode_count, (SELECT count(*) FROM q{tag}) AS complete_outcome_count,
  (SELECT count(*) FROM q{tag})::DOUBLE / (SELECT count(*) FROM lab WHERE split = '{split}') AS outcome_coverage, (SELECT count(*) FILTER (known_label_count = 0) FROM q{tag}) AS complete_empty_known_label_count,
  (SELECT count(*) FILTER (unknown_alarm_code_count > 0) FROM q{tag}) AS unknown_label_query_count, (SELECT avg(hit_at_k::INTEGER) FROM q{tag}) AS mean_hit_at_k, (SELECT avg(precision_at_k) FROM q{tag}) AS mean_precision_at_k,
  (SELECT avg(recall_at_k) FROM q{tag}) AS mean_recall_at_k, coalesce(tp / nullif(pp, 0), 0) AS micro_precision_at_k, coalesce(tp / nullif(ap, 0), 0) AS micro_recall_at_k,
  coalesce(2 * coalesce(tp / nullif(pp, 0), 0) * coalesce(tp / nullif(ap, 0), 0) / nullif(coalesce(tp / nullif(pp, 0), 0) + coalesce(tp / nullif(ap, 0), 0), 0), 0) AS micro_f1_at_k, macro AS macro_f1_at_k, labels AS evaluated_label_count
  FROM (SELECT sum(true_positive_count)::DOUBLE AS tp, sum(predicted_positive_count)::DOUBLE AS pp, sum(evaluation_support)::DOUBLE AS ap, avg(f1_at_k) FILTER (evaluation_support > 0) AS macro, count(*) FILTER (evaluation_support > 0) AS labels FROM l{tag}))"""


SCORED = f"{BASE}, {FREQUENCIES}, {SCOPES}"
SPLIT_DOUBLES = ("outcome_coverage", "mean_hit_at_k", "mean_precision_at_k", "mean_recall_at_k", "micro_precision_at_k", "micro_recall_at_k", "micro_f1_at_k", "macro_f1_at_k")
ROUNDED = "* REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in SPLIT_DOUBLES) + ")"
PROFILE_SQL = f"""{BASE} SELECT split, count(*) AS episode_count, count(*) FILTER (is_complete) AS complete_outcome_count, count(*) FILTER (is_complete)::DOUBLE / count(*) AS outcome_coverage, count(*) FILTER (NOT is_complete) AS incomplete_outcome_count,
  count(*) FILTER (is_complete AND len(codes) > 0) AS complete_with_future_alarm_count, count(*) FILTER (is_complete AND len(codes) = 0) AS complete_empty_outcome_count, count(*) FILTER (is_complete AND len(codes) = 0)::DOUBLE / nullif(count(*) FILTER (is_complete), 0) AS complete_empty_outcome_share,
  avg(len(known_codes)) FILTER (is_complete) AS mean_known_label_count, count(*) FILTER (is_complete AND len(unknown_codes) > 0) AS unknown_label_query_count, count(*) FILTER (is_complete AND len(unknown_codes) > 0)::DOUBLE / nullif(count(*) FILTER (is_complete), 0) AS unknown_label_query_share,
  coalesce(sum(len(unknown_codes)) FILTER (is_complete), 0)::BIGINT AS unknown_alarm_code_occurrence_count, coalesce(sum(unknown_event_count) FILTER (is_complete), 0)::BIGINT AS unknown_alarm_event_count FROM enc GROUP BY split"""
GROUP_METRICS_SQL = f"""{SCORED}, {GROUPED}, {measures(Y.TRANSITION, SPLIT, 'a')}, gm AS (SELECT g.support_group, count(l.alarm_code) AS label_count, count(*) FILTER (evaluation_support > 0) AS evaluated_label_count, coalesce(sum(evaluation_support), 0)::BIGINT AS evaluation_positive_count,
  coalesce(sum(predicted_positive_count), 0)::BIGINT AS predicted_positive_count, coalesce(sum(true_positive_count), 0)::BIGINT AS true_positive_count, avg(f1_at_k) FILTER (evaluation_support > 0) AS macro_f1_at_k
  FROM {EVERY_GROUP} LEFT JOIN grp x USING (support_group) LEFT JOIN la l ON l.alarm_code = x.alarm_code GROUP BY 1), pq AS (SELECT *, coalesce(true_positive_count::DOUBLE / nullif(predicted_positive_count, 0), 0) AS p, coalesce(true_positive_count::DOUBLE / nullif(evaluation_positive_count, 0), 0) AS r FROM gm)
SELECT support_group, label_count, evaluated_label_count, evaluation_positive_count, predicted_positive_count, true_positive_count, round(p, 9) AS micro_precision_at_k, round(r, 9) AS micro_recall_at_k, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS micro_f1_at_k, round(macro_f1_at_k, 9) AS macro_f1_at_k FROM pq"""
SELECT_SQL = f"""{SCORED}, {measures(Y.GLOBAL, 'validation', 'g')}, {measures(Y.MACHINE, 'validation', 'm')}, {measures(Y.TRANSITION, 'validation', 't')}, every AS (SELECT *, 0 AS complexity_rank FROM sg UNION ALL SELECT *, 1 FROM sm UNION ALL SELECT *, 2 FROM st),
near AS (SELECT *, max(macro_f1_at_k) OVER () AS best_macro_f1 FROM every QUALIFY macro_f1_at_k >= best_macro_f1 - 0.01::DOUBLE)
SELECT {ROUNDED[:-1]}, round(best_macro_f1, 9) AS best_macro_f1), (SELECT count(*) FROM near) AS eligible_model_count, 0.01::DOUBLE AS macro_f1_tolerance FROM near ORDER BY micro_f1_at_k DESC, macro_f1_at_k DESC, complexity_rank, model_version LIMIT 1"""
ALL_SPLITS_SQL = f"{SCORED}, " + ", ".join(measures(m, s, f"{m[0]}{s[0]}") for m in MODELS for s in ("validation", SPLIT)) + f" SELECT {ROUNDED} FROM (" + " UNION ALL ".join(f"SELECT * FROM s{m[0]}{s[0]}" for m in MODELS for s in ("validation", SPLIT)) + ")"
ONLINE_SQL = f"""{SCORED}, {predictions(Y.TRANSITION, 'pr')}, tot AS (SELECT coalesce(sum(machine_samples), 0)::BIGINT AS n FROM ms WHERE machine_samples >= {LEAST_MACHINE})
SELECT p.incident_id, rank::INTEGER AS rank, p.alarm_code, round(score, 9) AS model_score, '{Y.TRANSITION}' AS model_version, {HOURS}::DOUBLE AS forecast_horizon_hours, p.scope AS baseline_scope,
  CASE p.scope WHEN 'transition' THEN s.state_samples WHEN 'machine_fallback' THEN s.machine_samples ELSE tot.n END AS train_support FROM pr p JOIN sc s USING (incident_id) CROSS JOIN tot WHERE p.split = '{SPLIT}'"""

FORECAST = {
    "forecast_labels": (labels_query(False), labels_sql(False)),
    "forecast_labels_dense": (labels_query(True), labels_sql(True)),
    "forecast_vocabulary": (lambda s, d: Forecast(s, d, False).vocabulary, f"WITH {labels_cte(False)} SELECT alarm_code, support FROM voc"),
    "forecast_encoded": (lambda s, d: joined_arrays(Forecast(s, d).codes.select("incident_id", "known_codes")), f"{BASE} SELECT incident_id, array_to_string(known_codes, ' ') AS known_codes FROM enc"),
    "forecast_unknowns": (lambda s, d: joined_arrays(Forecast(s, d, False).codes.select("incident_id", "unknown_codes", "unknown_code_count", "unknown_event_count")), f"WITH {labels_cte(False)} SELECT incident_id, array_to_string(unknown_codes, ' ') AS unknown_codes, len(unknown_codes)::BIGINT AS unknown_code_count, unknown_event_count FROM enc"),
    "forecast_split_profile": (lambda s, d: (lambda f: Y.split_profile(f.labels, f.codes))(Forecast(s, d)), PROFILE_SQL),
    "support_profile": (lambda s, d: Y.support_profile(Forecast(s, d, False).labels), f"WITH {labels_cte(False)}, {SUPPORT} SELECT * FROM sup"),
    "support_groups": (lambda s, d: Forecast(s, d).groups(), f"{BASE}, {GROUPED} SELECT * FROM grp"),
    "support_group_summary": (lambda s, d: Y.support_group_summary(Forecast(s, d).groups()), f"{BASE}, {GROUPED}, n AS (SELECT g.support_group, count(alarm_code) AS label_count, coalesce(sum(train_sample_support), 0)::BIGINT AS positive_sample_count FROM {EVERY_GROUP} LEFT JOIN grp USING (support_group) GROUP BY 1) SELECT *, label_count::DOUBLE / sum(label_count) OVER () AS label_share, positive_sample_count::DOUBLE / sum(positive_sample_count) OVER () AS positive_sample_share FROM n"),
    "global_frequency": (lambda s, d: Y.fit_global(Forecast(s, d).labels), f"{SCORED} SELECT alarm_code, score, samples FROM fglobal"),
    "machine_frequency": (lambda s, d: Y.fit_machine(Forecast(s, d).labels), f"{SCORED} SELECT * FROM fmachine"),
    "transition_frequency": (lambda s, d: Y.fit_transition(Forecast(s, d).labels), f"{SCORED} SELECT * FROM fstate"),
    "forecast_scopes": (lambda s, d: Y.scopes(Forecast(s, d).labels, Y.TRANSITION, LEAST_MACHINE, LEAST_TRANSITION).select("incident_id", "baseline_scope", "machine_samples", "state_samples"), f"{SCORED} SELECT incident_id, scope AS baseline_scope, machine_samples, state_samples FROM sc"),
    "forecast_topk": (lambda s, d: rounded(Y.flat_predictions(Forecast(s, d).predicted())), f"{SCORED}, {predictions(Y.TRANSITION, 'pr')} SELECT incident_id, scope AS baseline_scope, rank::INTEGER AS rank, alarm_code, round(score, 9) AS score FROM pr"),
    "forecast_query_metrics": (lambda s, d: Forecast(s, d).per_query(), f"{SCORED}, {measures(Y.TRANSITION, SPLIT, 'a')} SELECT * FROM qa"),
    "forecast_per_label": (lambda s, d: rounded(Forecast(s, d).per_label()), f"{SCORED}, {measures(Y.TRANSITION, SPLIT, 'a')} SELECT * REPLACE (round(f1_at_k, 9) AS f1_at_k, round(precision_at_k, 9) AS precision_at_k, round(recall_at_k, 9) AS recall_at_k) FROM la"),
    "forecast_split_metrics": (all_split_metrics, ALL_SPLITS_SQL),
    "support_group_metrics": (lambda s, d: (lambda f: rounded(Y.support_group_metrics(f.per_label(), f.groups())))(Forecast(s, d)), GROUP_METRICS_SQL),
    "scope_profile": (lambda s, d: Y.scope_profile(Forecast(s, d).predicted(), SPLIT), f"{SCORED} SELECT scope AS baseline_scope, count(*) AS query_count FROM sc WHERE split = '{SPLIT}' AND is_complete GROUP BY 1"),
    "model_selection": (model_selection, SELECT_SQL),
    "online_forecast": (online, ONLINE_SQL),
}

# ------------------------------------------------------------------ investigation, samples, sequences


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.observed_episodes(flagged(spark, sf_dir), Inputs(spark, sf_dir).events)


def bundle_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest episode of each machine, observed through a bundle that was written, committed and loaded."""
    from .bundles import Bundle, Loader, load_investigation_resources, write_investigation_bundle

    bundle = Bundle(spark, f"{shared_folder(spark).rstrip('/')}/bundle-{uuid.uuid4().hex}")
    events = stored(processed(spark, sf_dir))
    write_investigation_bundle(bundle, events, flagged(spark, sf_dir), event_mapping(events))
    held = load_investigation_resources(Loader(bundle), HOURS)
    latest = held.flagged.groupBy("machine_id").agg(F.max_by("incident_id", F.struct("start_time", "incident_id")).alias("incident_id")).select("incident_id")
    return stored_then_removed(V.observed_episodes(held.flagged.join(latest, "incident_id", "left_semi"), held.events), bundle.root)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined_arrays(rounded(V.retrieved_evidence(*V.online_results(Inputs(spark, sf_dir), "test"))))


OBSERVED_SQL = f"""{WITH_FLAGS}, {O.MAPPING} SELECT f.incident_id, f.machine_id, f.split, f.start_time, f.end_time, f.duration_seconds, f.event_count, f.distinct_alarm_count, f.upper_tail_flag_count > 0 AS is_upper_tail,
  concat_ws(' ', CASE WHEN is_high_event_count THEN 'high_event_count' END, CASE WHEN is_high_duration_seconds THEN 'high_duration' END, CASE WHEN is_high_distinct_alarm_count THEN 'high_distinct_alarm_count' END) AS upper_tail_flags,
  m.event_position + 1 AS position, m.timestamp, m.alarm_code, CASE WHEN m.event_position > 0 THEN m.gap_seconds END AS gap_seconds FROM flagged f JOIN mapped m USING (incident_id)"""
EVIDENCE_SQL = f"""{FEATURES}, {future(6)}, {similarity(1.0, 'c.end_us < q.start_us', 'true').replace("'validation'", "'test'")}
SELECT r.q AS query_incident_id, rank::INTEGER AS rank, r.c AS incident_id, f.machine_id, f.start_time, f.end_time, round(similarity, 9) AS similarity_score,
  (SELECT coalesce(array_to_string(list_sort(list_intersect(list_distinct(string_split(dq.alarm_document, ' ')), list_distinct(string_split(dc.alarm_document, ' ')))), ' '), '')) AS shared_alarm_codes,
  array_to_string(f.codes, ' ') AS future_alarm_codes, f.is_complete AS outcome_is_complete, 6.0::DOUBLE AS future_horizon_hours FROM ranked r JOIN fut f ON f.incident_id = r.c JOIN docs dq ON dq.incident_id = r.q JOIN docs dc ON dc.incident_id = r.c WHERE rank <= 5"""
WINDOWS = (1720, 480)
OFFSETS = (0, 60, 120)
SAMPLES = f"""anch AS (SELECT e.*, o.start_offset, us - min(us) OVER (PARTITION BY machine_id) - o.start_offset * 60000000::BIGINT AS since FROM ev e CROSS JOIN (VALUES (0), (60), (120)) o(start_offset)),
bins AS (SELECT *, since // {WINDOWS[0] * 60_000_000} AS bin FROM anch WHERE since >= 0),
parts AS (SELECT machine_id, start_offset, us, source_row, alarm_code, bin, 'x' AS part FROM bins UNION ALL SELECT machine_id, start_offset, us, source_row, alarm_code, bin - 1, 'y' FROM bins WHERE bin >= 1 AND since - bin * {WINDOWS[0] * 60_000_000} < {WINDOWS[1] * 60_000_000}),
pairs AS (SELECT machine_id, start_offset, bin, list(alarm_code ORDER BY us, source_row) FILTER (part = 'x') AS x, list(alarm_code ORDER BY us, source_row) FILTER (part = 'y') AS y FROM parts GROUP BY ALL HAVING x IS NOT NULL AND y IS NOT NULL)"""
COLLAPSED = "list_transform(list_filter(list_zip({0}, list_concat([NULL], {0})[:len({0})]), lambda z: z[1] IS DISTINCT FROM z[2]), lambda z: z[1])"
PADDED_SQL = f"""WITH {O.events()}, {SAMPLES}, col AS (SELECT machine_id, start_offset, bin, {COLLAPSED.format('x')} AS x, {COLLAPSED.format('y')} AS y FROM pairs),
size AS (SELECT floor(avg(len(x)) + 3 * stddev_pop(len(x)))::BIGINT + 1 AS lx, max(len(y)) AS ly FROM col),
num2 AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY machine_id, start_offset ORDER BY bin) AS i FROM col WINDOW w AS (PARTITION BY machine_id, start_offset))
SELECT machine_id, start_offset, bin, array_to_string(list_resize(x[:lx], lx, '0'), ' ') AS x, array_to_string(list_resize(y[:ly], ly, '0'), ' ') AS y, CASE WHEN i <= n - ceil(n * (1 - 0.7::DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM num2 CROSS JOIN size WHERE n > 1"""
#: The job starts windows at every so many minutes of an input window.
STEP = 240
JOB_SQL = PADDED_SQL.replace("(VALUES (0), (60), (120)) o(start_offset)", f"(SELECT unnest(range(0, {WINDOWS[0]}, {STEP}))::INT AS start_offset) o")
SEQUENCE_SQL = f"""WITH {O.episodes()}, {O.MAPPING}, {DOCUMENTS}, tv AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT DISTINCT alarm_code AS token FROM mapped WHERE split = 'train')),
mv AS (SELECT machine_id, row_number() OVER (ORDER BY machine_id) AS id FROM (SELECT DISTINCT machine_id FROM inc WHERE split = 'train')),
pos AS (SELECT incident_id, event_position, coalesce(tv.id, 1) AS id, count(*) OVER (PARTITION BY incident_id) AS n FROM mapped LEFT JOIN tv ON tv.token = alarm_code)
SELECT d.incident_id, array_to_string(list_resize(list(p.id ORDER BY p.event_position), 8, 0), ' ') AS token_ids, least(any_value(p.n), 8)::INTEGER AS sequence_length, coalesce(any_value(mv.id), 0)::INTEGER AS machine_number
FROM docs d JOIN pos p USING (incident_id) LEFT JOIN mv USING (machine_id) WHERE p.event_position >= p.n - 8 GROUP BY d.incident_id"""

PRODUCTION_LENGTH = Forecasting().sequence_max_length
FULL_SEQUENCE_SQL = SEQUENCE_SQL.replace(", 8, 0)", f", {PRODUCTION_LENGTH}, 0)").replace("(p.n), 8)", f"(p.n), {PRODUCTION_LENGTH})").replace("p.n - 8 ", f"p.n - {PRODUCTION_LENGTH} ")


def sample_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job's three stored phases over a grid of one cell, its samples written as JSON and read back."""
    folder = f"{shared_folder(spark).rstrip('/')}/samples-{uuid.uuid4().hex}"
    grid = parameter_grid(WINDOWS[:1], WINDOWS[1:], (1,), (3.0,), (STEP,))
    (samples,) = create_samples(table_events(spark, sf_dir), grid, folder).values()
    write_samples(samples, f"{folder}/json")
    return stored_then_removed(joined_arrays(read_samples(spark, f"{folder}/json")), folder)


def npz_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded samples written as npz files by several tasks and read back in ranges of rows."""
    from ..sources.npz import register

    register(spark)
    path = f"{shared_folder(spark).rstrip('/')}/npz-{uuid.uuid4().hex}"
    samples = stored(S.padded_samples(S.paired_sequences(table_events(spark, sf_dir), OFFSETS, *WINDOWS)))
    samples.repartition(4).write.format("npz").mode("overwrite").save(path)
    return stored_then_removed(joined_arrays(spark.read.format("npz").schema(samples.schema).load(path)), path)


def sequences(length: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        documents = Inputs(spark, sf_dir).documents
        ids = F.array_join(F.transform("token_ids", lambda x: x.cast("string")), " ")
        return Q.encode(documents, Q.fit(documents), length).select("incident_id", ids.alias("token_ids"), "sequence_length", "machine_number")

    return query


OTHER = {
    "observed_episode": (observed, OBSERVED_SQL),
    "bundle_observed": (bundle_observed, f"SELECT * FROM ({OBSERVED_SQL}) WHERE incident_id IN (SELECT arg_max(incident_id, (start_time, incident_id)) FROM ({OBSERVED_SQL}) GROUP BY machine_id)"),
    "retrieved_evidence": (evidence, EVIDENCE_SQL),
    "episode_options": (lambda s, d: V.episode_options(flagged(s, d)), f"{WITH_FLAGS} SELECT incident_id, machine_id, split, start_time, end_time, event_count, upper_tail_flag_count > 0 AS is_upper_tail FROM flagged"),
    "machine_ids": (lambda s, d: V.machine_ids(table_events(s, d)), f"WITH {O.events()} SELECT DISTINCT machine_id FROM ev"),
    "window_samples": (lambda s, d: S.windowed(table_events(s, d), OFFSETS, *WINDOWS), f"WITH {O.events()}, {SAMPLES} SELECT machine_id, start_offset, us, source_row, alarm_code, bin, part FROM parts"),
    "pruned_sequences": (lambda s, d: joined_arrays(S.paired_sequences(table_events(s, d), OFFSETS, *WINDOWS)), f"WITH {O.events()}, {SAMPLES} SELECT machine_id, start_offset, bin, array_to_string(x, ' ') AS x, array_to_string(y, ' ') AS y FROM pairs"),
    "padded_sequences": (lambda s, d: joined_arrays(S.padded_samples(S.paired_sequences(table_events(s, d), OFFSETS, *WINDOWS))), PADDED_SQL),
    "npz_samples": (npz_samples, PADDED_SQL),
    "sample_job": (sample_job, JOB_SQL),
    "sequence_encoding": (sequences(PRODUCTION_LENGTH), FULL_SEQUENCE_SQL),
    "sequence_encoding_production": (sequences(PRODUCTION_LENGTH), FULL_SEQUENCE_SQL),
}


def linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.linear import score_linear

    forecast = Forecast(spark, sf_dir)
    return score_linear(forecast.inputs.episodes, forecast.inputs.documents, forecast.labels)


def gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.recurrent import score_gru

    forecast = Forecast(spark, sf_dir)
    return score_gru(forecast.inputs.documents, forecast.labels)


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.sessions import streaming_sessions

    return streaming_sessions(processed(spark, sf_dir)).drop("first_alarm_code", "last_alarm_code")


def replayed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The train log of all machines replayed as a stream of files in time order, and the counts that its state has at the end."""
    from ..streaming.transitions import current_counts, write_transition_changes

    base = f"{shared_folder(spark).rstrip('/')}/replay-{uuid.uuid4().hex}"
    train = stored(processed(spark, sf_dir, True).where("split = 'train'").select("timestamp", "machine_id", "source_row", "alarm_code"))
    *cuts, _ = train.agg(F.percentile_approx(F.unix_micros(F.col("timestamp").cast("timestamp")), [0.25, 0.5, 0.75, 1.0], 10_000)).first()[0] or [0]
    us = F.unix_micros(F.col("timestamp").cast("timestamp"))
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):  # one after another, as a log is written
        part = train.where((us > F.lit(low)) if low is not None else F.lit(True)).where((us <= F.lit(high)) if high is not None else F.lit(True))
        part.repartition(1).write.mode("append").parquet(f"{base}/log")  # filtered by many tasks; a file is one batch of the stream
    end = train.agg((F.max("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp")).select("timestamp", F.lit(None).cast("string").alias("machine_id"), F.lit(-1).cast("long").alias("source_row"), F.lit(None).cast("string").alias("alarm_code"))
    end.write.mode("append").parquet(f"{base}/log")
    log = spark.readStream.schema(train.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    write_transition_changes(log, f"{base}/changes", f"{base}/state", hours=HOURS, lateness="1 second").awaitTermination()
    return stored_then_removed(current_counts(spark.read.schema(COUNTS).parquet(f"{base}/changes")), base)


HITS_SQL = f"""{BASE}, h AS (SELECT machine_id, last_alarm_code, alarm_code, count(*) AS hits FROM (SELECT machine_id, last_alarm_code, unnest(codes) AS alarm_code FROM trn) GROUP BY ALL),
n AS (SELECT machine_id, last_alarm_code, count(*) AS samples FROM trn GROUP BY ALL)
SELECT machine_id, last_alarm_code, alarm_code, hits, samples FROM h JOIN n USING (machine_id, last_alarm_code)"""

#: The models have no SQL; the session windows have that of the batch rule.
OTHER |= {
    "linear_forecast": (linear, None),
    "gru_forecast": (gru, None),
    "model_selection_of_seven": (selection_of_seven, None),
    "streaming_transitions": (replayed_transitions, HITS_SQL),
    "streaming_sessions": (streamed, f"WITH {O.episodes()} SELECT machine_id, split, start_time, end_time, event_count FROM inc"),
}
