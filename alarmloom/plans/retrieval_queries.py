"""Queries over features, candidates, outcomes and retrieval, with their SQL."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import stored
from ..operators import features as X
from ..operators import retrieval as R
from ..operators import windows as W
from ..operators.episodes import identify_events, summarize
from . import oracle_base as O
from .log_queries import processed

HOURS = (1.0, 6.0, 24.0)
THRESHOLDS = (0.1, 0.3, 0.5)


class Inputs:
    """Frames that the queries share, stored as many branches of one query read them."""

    def __init__(self, spark: SparkSession, sf_dir: str, dense: bool = False):
        self.events = stored(processed(spark, sf_dir, dense))
        self.episodes = stored(summarize(self.events))

    @cached_property
    def documents(self) -> DataFrame:
        return stored(X.documents_of(identify_events(self.events)))

    def vectors(self, shape: float) -> DataFrame:
        return X.feature_vectors(self.episodes, self.documents, 1.0, shape)

    def outcomes(self, hours: float) -> DataFrame:
        return W.future_outcomes(self.episodes, self.events, hours)

    def queries(self, split: str = "validation") -> DataFrame:
        return self.episodes.where(F.col("split") == split).select("incident_id", "split")


def joined_arrays(df: DataFrame) -> DataFrame:
    return df.select(*(F.array_join(c, " ").alias(c) if t == "array<string>" else F.col(c) for c, t in df.dtypes))


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def outcomes_query(hours: float):
    return lambda s, d: joined_arrays(Inputs(s, d).outcomes(hours))


def evaluable(inputs: Inputs, hours: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes, all queries, and those whose outcome can be compared."""
    outcomes = stored(inputs.outcomes(hours))
    queries = inputs.queries()
    return outcomes, queries, queries.join(outcomes.where("outcome_is_complete AND has_future_alarms").select("incident_id"), "incident_id", "left_semi")


def topk(shape: float):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = Inputs(spark, sf_dir)
        outcomes, _, usable = evaluable(inputs, 6.0)
        rows = R.top_candidates(inputs.episodes, inputs.vectors(shape), outcomes, usable, R.Search())
        version = X.COMBINED_VERSION if shape else X.ALARM_VERSION
        out = R.ranked_results(rows, inputs.episodes, R.raw_codes(inputs.documents), version, "expanding_history")
        return rounded(joined_arrays(out))

    return query


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Online retrieval (history gate only) for validation episodes, with the labels its results would get."""
    inputs = Inputs(spark, sf_dir)
    search = R.Search(outcome_gate=False)
    rows = R.top_candidates(inputs.episodes, inputs.vectors(1.0), None, inputs.queries(), search)
    results = R.ranked_results(rows, inputs.episodes, R.raw_codes(inputs.documents), X.COMBINED_VERSION, search.policy)
    labelled = R.label_relevance(results, inputs.episodes, inputs.outcomes(6.0), 0.3)
    kept = ("query_incident_id", "rank", "candidate_incident_id", "similarity_score", "query_outcome_is_complete", "query_has_future_alarms", "candidate_outcome_is_complete", "candidate_outcome_available_before_query", "evaluation_eligible", "outcome_jaccard", "relevance_threshold", "is_relevant")
    # a double, as null, true and false in one column are read in more than one way
    return rounded(labelled.select(*kept).withColumn("is_relevant", F.col("is_relevant").cast("double")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    search, inputs = R.Search(), Inputs(spark, sf_dir)
    outcomes, queries, usable = evaluable(inputs, 6.0)
    rows = R.retrieve(inputs.episodes, inputs.vectors(1.0), outcomes, usable, search)
    return R.query_records(queries, outcomes, rows, search, X.COMBINED_VERSION)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both feature versions, all horizons and thresholds on validation; pools and relevant candidates are counted once a horizon."""
    inputs, search, parts = Inputs(spark, sf_dir), R.Search(thresholds=THRESHOLDS), []
    versions = [(shape, version, stored(inputs.vectors(shape))) for shape, version in ((0.0, X.ALARM_VERSION), (1.0, X.COMBINED_VERSION))]
    for hours in HOURS:
        outcomes, queries, usable = evaluable(inputs, hours)
        counts = None
        for shape, version, vectors in versions:
            rows = stored(R.searchable(inputs.episodes, vectors, outcomes, usable, search))
            counts = stored(R.counted(rows, search)) if counts is None else counts
            found = counts.join(R.best_candidates(rows, search).drop("worked"), "incident_id")
            scored = R.query_records(queries, outcomes, found, search, version)
            parts.append(scored.withColumns({"future_horizon_hours": F.lit(hours), "shape_weight": F.lit(shape)}))
    by = ("split", "feature_version", "future_horizon_hours", "relevance_threshold", "k", "candidate_policy", "shape_weight")
    out = R.split_metrics(reduce(DataFrame.unionByName, parts), by)
    return rounded(out.withColumnsRenamed({"split": "selection_split", "k": "top_k"}).withColumns({"alarm_weight": F.lit(1.0), "query_limit": F.lit(None).cast("double")}))


# ------------------------------------------------------------------ SQL

DOCUMENTS = "docs AS (SELECT incident_id, any_value(machine_id) AS machine_id, any_value(split) AS split, string_agg(alarm_code, ' ' ORDER BY event_position) AS alarm_document, count(*) AS alarm_token_count FROM mapped GROUP BY incident_id)"
TFIDF = """tok AS (SELECT incident_id, split, alarm_code AS token, count(*) AS n FROM mapped WHERE alarm_code <> '' GROUP BY ALL),
ntrain AS (SELECT count(*) AS n FROM docs WHERE split = 'train'),
idf AS (SELECT token, count(*) AS document_frequency, ln((1.0 + any_value(t.n)) / (1 + count(*))) + 1 AS idf FROM tok CROSS JOIN ntrain t WHERE split = 'train' GROUP BY token),
rawtf AS (SELECT incident_id, token, tok.n * idf AS raw FROM tok JOIN idf USING (token)),
tfidf AS (SELECT incident_id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY incident_id)) AS weight FROM rawtf)"""
Z = {c: f"(ln(1 + {c}) - (SELECT avg(ln(1 + {c})) FROM inc WHERE split = 'train')) / (SELECT CASE WHEN stddev_pop(ln(1 + {c})) = 0 THEN 1 ELSE stddev_pop(ln(1 + {c})) END FROM inc WHERE split = 'train')" for c in X.SHAPE}
SHAPE = "shp AS (SELECT incident_id, " + ", ".join(f"{e} AS {c}_z" for c, e in Z.items()) + " FROM inc)"
LENGTH = "sqrt(" + " + ".join(f"{c}_z * {c}_z" for c in X.SHAPE) + ")"
NORMS = f"norms AS (SELECT s.*, {LENGTH} AS shape_size, ({LENGTH} > 0)::INTEGER::DOUBLE AS shape_length, (incident_id IN (SELECT incident_id FROM tfidf))::INTEGER::DOUBLE AS alarm_length FROM shp s)"
FEATURES = f"WITH {O.episodes()}, {O.MAPPING}, {DOCUMENTS}, {TFIDF}, {SHAPE}, {NORMS}"


def future(hours: float, scope: str = "machine_id", name: str = "fut") -> str:
    h = round(hours * 3_600_000_000)
    on = " AND ".join(f"e.{c.strip()} = i.{c.strip()}" for c in scope.split(","))
    same = " AND ".join(f"i.{c.strip()} = l.{c.strip()}" for c in scope.split(","))
    return f"""{name}_pairs AS (
  SELECT i.incident_id, e.alarm_code, count(*) AS n FROM inc i JOIN proc e ON {on} AND e.us > i.end_us AND e.us <= i.end_us + {h} GROUP BY ALL
), {name}_last AS (SELECT {scope}, max(us) AS last_us FROM proc GROUP BY ALL),
{name} AS (
  SELECT i.*, i.end_us + {h} AS out_us, l.last_us, coalesce(l.last_us >= i.end_us + {h}, false) AS is_complete,
         coalesce(p.events, 0)::BIGINT AS events, coalesce(p.codes, []) AS codes, coalesce(p.counts, '') AS counts
  FROM inc i LEFT JOIN {name}_last l ON {same}
  LEFT JOIN (SELECT incident_id, sum(n) AS events, list(alarm_code ORDER BY alarm_code) AS codes, string_agg(alarm_code || ':' || n, ' ' ORDER BY alarm_code) AS counts FROM {name}_pairs GROUP BY 1) p USING (incident_id))"""


def outcomes_sql(hours: float) -> str:
    return f"""WITH {O.episodes()}, {future(hours)}
SELECT incident_id, end_time AS outcome_start_time, make_timestamp(out_us) AS outcome_end_time, make_timestamp(last_us) AS outcome_observed_through, is_complete AS outcome_is_complete,
       {hours}::DOUBLE AS future_horizon_hours, events AS future_event_count, len(codes)::BIGINT AS distinct_future_alarm_count, array_to_string(codes, ' ') AS future_alarm_codes, len(codes) > 0 AS has_future_alarms FROM fut"""


def similarity(shape: float, gate: str, usable: str, name: str = "ranked", fut: str = "fut") -> str:
    """Pairs under ``gate``, their similarity and Jaccard, ranked."""
    z = " + ".join(f"q.{c}_z * c.{c}_z" for c in X.SHAPE)
    return f"""{name}_all AS (
  SELECT q.incident_id AS q, c.incident_id AS c, c.end_us AS c_end, q.codes AS q_codes, c.codes AS c_codes
  FROM {fut} q JOIN {fut} c ON {gate} AND q.incident_id <> c.incident_id WHERE q.split = 'validation' AND {usable}
), {name}_dot AS (
  SELECT a.incident_id AS q, b.incident_id AS c, sum(a.weight * b.weight) AS dot FROM tfidf a JOIN inc i ON i.incident_id = a.incident_id AND i.split = 'validation'
  JOIN tfidf b USING (token) GROUP BY ALL
), {name}_jac AS (
  SELECT p.*, coalesce(len(list_intersect(q_codes, c_codes))::DOUBLE / nullif(len(q_codes) + len(c_codes) - len(list_intersect(q_codes, c_codes)), 0), 0) AS jaccard,
    round(coalesce((coalesce(d.dot, 0) + {shape * shape} * CASE WHEN q.shape_length * c.shape_length > 0 THEN ({z}) / (q.shape_size * c.shape_size) ELSE 0 END)
      / nullif(sqrt(q.alarm_length + {shape * shape} * q.shape_length) * sqrt(c.alarm_length + {shape * shape} * c.shape_length), 0), 0), 12) AS similarity
  FROM {name}_all p JOIN norms q ON q.incident_id = p.q JOIN norms c ON c.incident_id = p.c LEFT JOIN {name}_dot d ON d.q = p.q AND d.c = p.c
), {name} AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY similarity DESC, c_end DESC, c) AS rank FROM {name}_jac)"""


OUTCOME_GATE, USABLE = "c.is_complete AND c.out_us < q.start_us", "q.is_complete AND len(q.codes) > 0"
SHARED = "(SELECT coalesce(array_to_string(list_sort(list_intersect(list_distinct(string_split(dq.alarm_document, ' ')), list_distinct(string_split(dc.alarm_document, ' ')))), ' '), ''))"


def topk_sql(shape: float) -> str:
    version = X.COMBINED_VERSION if shape else X.ALARM_VERSION
    return f"""{FEATURES}, {future(6)}, {similarity(shape, OUTCOME_GATE, USABLE)}
SELECT r.q AS query_incident_id, rank::INTEGER AS rank, r.c AS candidate_incident_id, round(similarity, 9) AS similarity_score, '{version}' AS feature_version, 'expanding_history' AS candidate_policy,
       c.machine_id AS candidate_machine_id, c.start_time AS candidate_start_time, c.end_time AS candidate_end_time, q.machine_id = c.machine_id AS same_machine, {SHARED} AS shared_alarm_codes
FROM ranked r JOIN inc q ON q.incident_id = r.q JOIN inc c ON c.incident_id = r.c JOIN docs dq ON dq.incident_id = r.q JOIN docs dc ON dc.incident_id = r.c WHERE rank <= 5"""


RELEVANCE_SQL = f"""{FEATURES}, {future(6)}, {similarity(1.0, 'c.end_us < q.start_us', 'true')}
, labelled AS (SELECT r.*, fq.is_complete AS qc, len(fq.codes) > 0 AS qf, fc.is_complete AS cc, fc.out_us < fq.start_us AS av FROM ranked r JOIN fut fq ON fq.incident_id = r.q JOIN fut fc ON fc.incident_id = r.c WHERE rank <= 5)
SELECT q AS query_incident_id, rank::INTEGER AS rank, c AS candidate_incident_id, round(similarity, 9) AS similarity_score, qc AS query_outcome_is_complete, qf AS query_has_future_alarms, cc AS candidate_outcome_is_complete,
       av AS candidate_outcome_available_before_query, qc AND qf AND cc AND av AS evaluation_eligible, round(CASE WHEN qc AND qf AND cc AND av THEN jaccard END, 9) AS outcome_jaccard, 0.3::DOUBLE AS relevance_threshold,
       CASE WHEN qc AND qf AND cc AND av THEN (jaccard >= 0.3::DOUBLE)::INTEGER::DOUBLE END AS is_relevant FROM labelled"""


def records_cte(suffix: str, version: str, thresholds: tuple[float, ...], k: int = 5) -> str:
    values = ", ".join(f"({t}::DOUBLE)" for t in thresholds)
    ideal = " + ".join(f"CASE WHEN {i} <= rel THEN 1 / log2({i + 1}) ELSE 0 END" for i in range(1, k + 1))
    return f"""sums{suffix} AS (
  SELECT q, t.threshold, count(*) AS pool, count(*) FILTER (jaccard >= t.threshold) AS rel, least(count(*), {k}) AS retrieved,
         count(*) FILTER (rank <= {k} AND jaccard >= t.threshold) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k} AND jaccard >= t.threshold), 0) AS gain,
         min(rank) FILTER (rank <= {k} AND jaccard >= t.threshold) AS first
  FROM ranked{suffix} CROSS JOIN (VALUES {values}) t(threshold) GROUP BY q, t.threshold
), rec{suffix} AS (
  SELECT f.incident_id AS query_incident_id, f.split, t.threshold AS relevance_threshold,
    CASE WHEN NOT f.is_complete THEN 'query_outcome_incomplete' WHEN len(f.codes) = 0 THEN 'query_without_future_alarms' WHEN s.q IS NULL THEN 'no_evaluable_candidates' ELSE 'evaluated' END AS status,
    {k}::INTEGER AS k, 'expanding_history' AS candidate_policy, '{version}' AS feature_version, coalesce(pool, 0) AS evaluable_candidate_count, coalesce(rel, 0) AS total_relevant_candidate_count,
    rel::DOUBLE / pool AS relevant_candidate_share, retrieved::DOUBLE AS retrieved_count, hits::DOUBLE AS relevant_retrieved_count, (hits > 0)::INTEGER::DOUBLE AS hit_at_k, hits / {k}::DOUBLE AS precision_at_k,
    hits::DOUBLE / nullif(rel, 0) AS recall_at_k, least({k}, rel)::DOUBLE / nullif(rel, 0) AS maximum_recall_at_k, hits::DOUBLE / nullif(least({k}, rel), 0) AS recall_efficiency_at_k,
    least({k}, pool)::DOUBLE / {k} * (rel::DOUBLE / pool) AS expected_random_precision_at_k, (hits / {k}::DOUBLE) / nullif(least({k}, pool)::DOUBLE / {k} * (rel::DOUBLE / pool), 0) AS precision_lift_at_k,
    CASE WHEN s.q IS NOT NULL THEN coalesce(1.0::DOUBLE / first, 0) END AS reciprocal_rank, CASE WHEN s.q IS NOT NULL THEN gain / nullif({ideal}, 0) END AS ndcg_at_k
  FROM fut{suffix} f CROSS JOIN (VALUES {values}) t(threshold) LEFT JOIN sums{suffix} s ON s.q = f.incident_id AND s.threshold = t.threshold WHERE f.split = 'validation')"""


METRICS_SQL = """count(*) AS query_count, count(*) FILTER (status = 'evaluated') AS evaluated_query_count, count(*) FILTER (status = 'evaluated')::DOUBLE / count(*) AS evaluation_coverage,
""" + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}_count" for s in R.STATUSES[:3]) + """,
count(*) FILTER (status = 'evaluated' AND total_relevant_candidate_count > 0) AS query_with_relevant_candidates_count,
count(*) FILTER (status = 'evaluated' AND total_relevant_candidate_count > 0)::DOUBLE / count(*) AS relevant_candidate_query_share, """ + ", ".join(f"avg({m}) AS mean_{m}" for m in R.MEANS)
RECORDS = f"{FEATURES}, {future(6)}, {similarity(1.0, OUTCOME_GATE, USABLE)}, {records_cte('', X.COMBINED_VERSION, (0.3,))}"
RECORD_DOUBLES = ("relevant_candidate_share", "retrieved_count", "relevant_retrieved_count", "hit_at_k", *R.MEANS[1:3], *R.MEANS[4:])
MEAN_NAMES = ("evaluation_coverage", "relevant_candidate_query_share", *(f"mean_{m}" for m in R.MEANS))


def round_sql(columns: tuple[str, ...]) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, 9) AS {c}" for c in dict.fromkeys(columns)) + ")"


def grid_sql() -> str:
    parts, out = [FEATURES], []
    for hours in HOURS:
        tag = f"{int(hours)}"
        parts.append(future(hours, name=f"fut{tag}"))
        for shape, version in ((0.0, X.ALARM_VERSION), (1.0, X.COMBINED_VERSION)):
            own = f"{tag}_{int(shape)}"
            parts.append(f"fut{own} AS (SELECT * FROM fut{tag})")
            parts.append(similarity(shape, OUTCOME_GATE, USABLE, f"ranked{own}", f"fut{own}"))
            parts.append(records_cte(own, version, THRESHOLDS))
            out.append(f"SELECT split AS selection_split, feature_version, {hours}::DOUBLE AS future_horizon_hours, relevance_threshold, k AS top_k, candidate_policy, {shape}::DOUBLE AS shape_weight, 1.0::DOUBLE AS alarm_weight, NULL::DOUBLE AS query_limit, {METRICS_SQL} FROM rec{own} GROUP BY split, feature_version, relevance_threshold, k, candidate_policy")
    return ", ".join(parts) + f" SELECT {round_sql(MEAN_NAMES)} FROM (" + " UNION ALL ".join(out) + ")"


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = Inputs(spark, sf_dir)
    ready = inputs.outcomes(6.0).select("incident_id", F.when(F.col("outcome_is_complete"), F.col("outcome_end_time")).alias("ready"))
    rows = inputs.episodes.select("incident_id", "split", "start_time", "end_time").join(ready, "incident_id")
    names = {"history_pool": (F.col("end_time"), "expanding_history"), "train_history_pool": (F.col("end_time"), "train_only"), "evaluable_pool": (F.col("ready"), "expanding_history")}
    parts = [R.pool_sizes(rows, column, policy).withColumnRenamed("pool", name) for name, (column, policy) in names.items()]
    return reduce(lambda a, b: a.join(b, "incident_id"), parts)


POOLS_SQL = f"""WITH {O.episodes()}, {future(6)}
SELECT q.incident_id, (SELECT count(*) FROM inc c WHERE c.end_us < q.start_us) AS history_pool, (SELECT count(*) FROM inc c WHERE c.end_us < q.start_us AND c.split = 'train') AS train_history_pool,
       (SELECT count(*) FROM fut c WHERE c.is_complete AND c.out_us < q.start_us) AS evaluable_pool FROM inc q"""


def first_validation(inputs: Inputs) -> str:
    return inputs.episodes.where("split = 'validation'").orderBy("start_time", "incident_id").first()["incident_id"]


def candidates_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = Inputs(spark, sf_dir)
    return R.historical_candidates(inputs.episodes, first_validation(inputs)).select("incident_id", "machine_id", "end_time")


def evaluable_of_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = Inputs(spark, sf_dir)
    return R.evaluable_candidates(inputs.episodes, inputs.outcomes(6.0), first_validation(inputs)).select("incident_id", "machine_id", "end_time")


FIRST_SQL = "q AS (SELECT * FROM inc WHERE split = 'validation' ORDER BY start_time, incident_id LIMIT 1)"

RETRIEVAL = {
    "alarm_documents": (lambda s, d: Inputs(s, d).documents.select("incident_id", "alarm_document", "alarm_token_count"), f"WITH {O.episodes()}, {O.MAPPING}, {DOCUMENTS} SELECT incident_id, alarm_document, alarm_token_count FROM docs"),
    "tfidf_idf": (lambda s, d: rounded(X.fit_idf(Inputs(s, d).documents)), f"{FEATURES} SELECT token, document_frequency, round(idf, 9) AS idf FROM idf"),
    "tfidf_weights": (lambda s, d: rounded((lambda x: X.tfidf_weights(x, X.fit_idf(x)))(Inputs(s, d).documents)), f"{FEATURES} SELECT incident_id, token, round(weight, 9) AS weight FROM tfidf"),
    "shape_features": (lambda s, d: rounded((lambda x: X.shape_features(x, X.fit_shape(x)))(Inputs(s, d).episodes), 8), f"{FEATURES} SELECT incident_id, " + ", ".join(f"round({c}_z, 8) AS {c}_z" for c in X.SHAPE) + " FROM shp"),
    "combined_norms": (lambda s, d: rounded(Inputs(s, d).vectors(1.0).select("incident_id", "alarm_length", "shape_length", "norm")), f"{FEATURES} SELECT incident_id, alarm_length, shape_length, round(sqrt(alarm_length + shape_length), 9) AS norm FROM norms"),
    "historical_candidates": (candidates_of_first, f"WITH {O.episodes()}, {FIRST_SQL} SELECT i.incident_id, i.machine_id, i.end_time FROM inc i, q WHERE i.end_us < q.start_us"),
    "outcome_evaluable_candidates": (evaluable_of_first, f"WITH {O.episodes()}, {future(6)}, {FIRST_SQL} SELECT i.incident_id, i.machine_id, i.end_time FROM fut i, q WHERE i.is_complete AND i.out_us < q.start_us"),
    "candidate_pool_sizes": (pools, POOLS_SQL),
    **{f"future_outcomes_{int(h)}h": (outcomes_query(h), outcomes_sql(h)) for h in HOURS},
    "retrieval_topk_alarm": (topk(0.0), topk_sql(0.0)),
    "retrieval_topk_combined": (topk(1.0), topk_sql(1.0)),
    "retrieval_relevance": (relevance, RELEVANCE_SQL),
    "retrieval_query_metrics": (lambda s, d: rounded(records(s, d)), f"{RECORDS} SELECT {round_sql(RECORD_DOUBLES)} FROM rec"),
    "retrieval_split_metrics": (lambda s, d: rounded(R.split_metrics(records(s, d))), f"{RECORDS} SELECT {round_sql(MEAN_NAMES)} FROM (SELECT split, {METRICS_SQL} FROM rec GROUP BY split)"),
    "retrieval_grid": (grid, grid_sql()),
    "retrieval_diagnostics": (lambda s, d: rounded(R.diagnostics(grid(s, d))), "SELECT " + ", ".join(f"{c} AS {name}" for c, name in R.DIAGNOSTICS.items()) + f" FROM ({grid_sql()})"),
}
