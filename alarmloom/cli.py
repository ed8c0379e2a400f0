"""Jobs from the command line: prepare events and episodes, evaluate retrieval and forecasts."""

from __future__ import annotations

import argparse
from dataclasses import asdict
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.storage import stored
from .operators import baselines as B
from .operators import episodes as E
from .operators import features as X
from .operators import forecasting as Y
from .operators import ingest as I
from .operators import retrieval as R
from .operators import windows as W
from .plans import artifacts as A
from .plans.sample_job import SampleSettings, create_samples, parameter_grid, write_samples
from .plans.settings import Settings, load, parse
from .session import session
from .sources.events import read_alarm_csv


def prepare_data(spark: SparkSession, source: str, out: str, settings: Settings) -> None:
    shares = settings.split
    events = I.processed_events(read_alarm_csv(spark, source), shares.train_ratio, shares.validation_ratio, shares.test_ratio)
    A.write_frame(events, f"{out}/events.parquet")
    stored = spark.read.parquet(f"{out}/events.parquet")
    I.check_splits(stored)
    A.write_json(A.events_metadata(stored, source, asdict(settings), datetime.now(UTC)), f"{out}/events.metadata.json")


def prepare_incidents(spark: SparkSession, out: str, settings: Settings) -> None:
    events = spark.read.parquet(f"{out}/events.parquet")
    gap = settings.incidents.gap_minutes
    A.write_frame(E.summarize(events, gap), f"{out}/incident_summary.parquet")
    episodes = spark.read.parquet(f"{out}/incident_summary.parquet")
    overall, machines = B.fit_global(episodes, settings.baselines.quantile), B.fit_machines(episodes, settings.baselines.quantile, settings.baselines.minimum_incident_count)
    A.write_frame(B.apply_flags(episodes, overall, machines), f"{out}/incidents.parquet")
    A.write_frame(E.event_mapping(events, gap), f"{out}/incident_events.parquet")
    A.write_json({"global": overall.first().asDict(), "machines": [r.asDict() for r in machines.orderBy("machine_id").collect()], "settings": asdict(settings), "generated_at": A.checked_time(datetime.now(UTC))}, f"{out}/incident_baselines.json")


def stored_inputs(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events, episodes and documents; raises if the mapping and the episodes name different ids."""
    events, episodes, mapping = (spark.read.parquet(f"{out}/{n}.parquet") for n in ("events", "incidents", "incident_events"))
    ids, mapped = episodes.select("incident_id"), mapping.select("incident_id").distinct()
    if ids.join(mapped, "incident_id", "left_anti").union(mapped.join(ids, "incident_id", "left_anti")).limit(1).count():
        raise ValueError("episodes and documents have different ids")
    documents = X.alarm_documents(mapping, events).join(episodes.select("incident_id", "split", "machine_id"), "incident_id")
    return events, episodes, documents


def evaluate_retrieval(spark: SparkSession, out: str, settings: Settings, split: str, combos: list[tuple[str, float]], thresholds: tuple[float, ...], most: int | None = None) -> DataFrame:
    events, episodes, documents = stored_inputs(spark, out)
    own, parts = settings.retrieval, []
    search = R.Search(own.top_k, own.candidate_policy, True, thresholds)
    queries = episodes.where(F.col("split") == split)
    queries = queries.orderBy("start_time", "incident_id").limit(most) if most else queries
    for version, hours in combos:
        shape = 0.0 if version == X.ALARM_VERSION else own.shape_weight
        outcomes = W.future_outcomes(episodes, events, hours)
        asked = queries.join(outcomes.where("outcome_is_complete AND has_future_alarms").select("incident_id"), "incident_id", "left_semi")
        found = R.retrieve(episodes, X.feature_vectors(episodes, documents, own.alarm_weight, shape), outcomes, asked, search)
        records = R.query_records(queries, outcomes, found, search, version)
        parts.append(records.withColumns({"future_horizon_hours": F.lit(float(hours)), "shape_weight": F.lit(shape)}))
    by = ("split", "feature_version", "future_horizon_hours", "relevance_threshold", "k", "candidate_policy", "shape_weight")
    out_rows = R.split_metrics(reduce(DataFrame.unionByName, parts), by).withColumnsRenamed({"split": "selection_split", "k": "top_k"})
    return out_rows.withColumns({"alarm_weight": F.lit(own.alarm_weight), "query_limit": F.lit(most).cast("long")})


def sources_of(out: str) -> dict[str, str]:
    return {n: f"{out}/{n}.parquet" for n in ("events", "incidents", "incident_events")}


def validate_retrieval(spark: SparkSession, out: str, settings: Settings, results: str, most: int | None, diagnostics_only: bool = False) -> None:
    """Writes the measures of the whole grid and prints their short form; ``diagnostics_only`` prints and writes nothing."""
    own = settings.retrieval
    combos = [(v, h) for h in own.future_horizon_hours_candidates for v in (X.ALARM_VERSION, X.COMBINED_VERSION)]
    metrics = evaluate_retrieval(spark, out, settings, "validation", combos, own.relevance_threshold_candidates, most)
    metrics = stored(metrics)
    A.check_validation(metrics)
    print(R.diagnostics(metrics).toPandas().to_csv(index=False), end="")  # a row a setting
    if diagnostics_only:
        return
    A.write_metrics(metrics, f"{results}/retrieval_validation_results.csv")
    A.write_json(A.result_metadata(metrics, sources_of(out), asdict(own), "validation", datetime.now(UTC), query_limit=most, is_complete=most is None), f"{results}/retrieval_validation.metadata.json")


def test_retrieval(spark: SparkSession, out: str, settings: Settings, results: str) -> None:
    own = settings.retrieval
    if own.selected_feature_version is None:
        raise ValueError("retrieval has no selected settings")
    metrics = evaluate_retrieval(spark, out, settings, "test", [(own.selected_feature_version, own.future_horizon_hours)], (own.relevance_threshold,))
    metrics = stored(metrics)
    A.check_locked_test(metrics, "selection_split")
    A.write_metrics(metrics, f"{results}/retrieval_test_results.csv")
    chosen = {"feature_version": own.selected_feature_version, "future_horizon_hours": own.future_horizon_hours, "relevance_threshold": own.relevance_threshold}
    A.write_json(A.result_metadata(metrics, sources_of(out), asdict(own), "test", datetime.now(UTC), selected=chosen), f"{results}/retrieval_test.metadata.json")


def test_forecast(spark: SparkSession, out: str, settings: Settings, results: str) -> None:
    own = settings.forecasting
    if own.selected_model_version != Y.TRANSITION:
        raise ValueError("only the transition model can be evaluated on test")
    events, episodes, _ = stored_inputs(spark, out)
    labels = Y.with_context(W.forecast_labels(episodes, events, own.selected_forecast_horizon_hours), episodes.select("incident_id", "last_alarm_code"))
    vocabulary = Y.fit_vocabulary(labels)
    codes = Y.encoded(labels, vocabulary)
    predicted = Y.predict(labels, Y.TRANSITION, own.top_k, own.minimum_machine_train_samples, own.minimum_transition_train_samples)
    per_label = Y.label_metrics(labels, codes, predicted, vocabulary, "test")
    groups = Y.support_groups(Y.support_profile(labels), own.rare_max_train_support, own.common_min_train_support)
    metrics = Y.split_metrics(labels, Y.query_metrics(labels, codes, predicted, "test", own.top_k, Y.TRANSITION), per_label, "test", Y.TRANSITION, own.top_k)
    A.check_locked_test(metrics)
    A.write_metrics(metrics, f"{results}/forecast_test_results.csv")
    A.write_metrics(Y.support_group_metrics(per_label, groups), f"{results}/forecast_test_support_groups.csv")
    A.write_metrics(Y.scope_profile(predicted, "test"), f"{results}/forecast_test_scopes.csv")
    model = A.model_json(labels, own.minimum_machine_train_samples, own.minimum_transition_train_samples)
    A.write_json(model, f"{results}/forecast_model.json")
    about = {"model_version": model["model_version"], "alarm_code_count": len(model["alarm_codes"]), "transition_state_count": len(model["transitions"])}
    A.write_json(A.result_metadata(metrics, sources_of(out), asdict(own), "test", datetime.now(UTC), model=about), f"{results}/forecast_test.metadata.json")


def prepare_samples(spark: SparkSession, out: str, samples: str, grid: list[SampleSettings], start: int) -> None:
    """Samples of the stored events for each cell of ``grid``, as Parquet and as lines of JSON beside it."""
    for name, rows in create_samples(spark.read.parquet(f"{out}/events.parquet"), grid, samples, start).items():
        write_samples(rows, f"{samples}/{name}/json")


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="alarmloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("prepare-data", "prepare-incidents", "validate-retrieval", "test-retrieval", "test-forecast", "prepare-samples"):
        one = commands.add_parser(name)
        one.add_argument("--config", type=Path, help="TOML settings; defaults without")
        one.add_argument("--data", default="data/processed", help="folder of events and episodes")
        if name == "prepare-data":
            one.add_argument("source", help="CSV log with timestamp, alarm and serial")
        if name == "prepare-samples":
            one.add_argument("--samples", default="data/samples", help="folder of samples")
            one.add_argument("--start", type=int, choices=(1, 2, 3), default=1, help="first phase to run; those before are taken from the folder")
            for option, kind, default in (("inputs", int, 1720), ("outputs", int, 480), ("min-counts", int, 20), ("sigmas", float, 3.0), ("offset-steps", int, 60)):
                one.add_argument(f"--{option}", type=kind, nargs="+", default=[default])
        elif name not in ("prepare-data", "prepare-incidents"):
            one.add_argument("--results", "--output-dir", default="data/results", help="folder of results")
        if name == "validate-retrieval":
            one.add_argument("--max-validation-queries", type=int, default=None, help="evaluate the first queries only, for a quick look")
            one.add_argument("--diagnostics-only", action="store_true", help="print the short measures as CSV and write nothing")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    settings = parse(load(args.config)) if args.config else Settings()
    spark = session()
    if args.command == "prepare-data":
        prepare_data(spark, args.source, args.data, settings)
    elif args.command == "prepare-incidents":
        prepare_incidents(spark, args.data, settings)
    elif args.command == "validate-retrieval":
        validate_retrieval(spark, args.data, settings, args.results, args.max_validation_queries, args.diagnostics_only)
    elif args.command == "test-retrieval":
        test_retrieval(spark, args.data, settings, args.results)
    elif args.command == "prepare-samples":
        grid = parameter_grid(args.inputs, args.outputs, args.min_counts, args.sigmas, args.offset_steps)
        prepare_samples(spark, args.data, args.samples, grid, args.start)
    else:
        test_forecast(spark, args.data, settings, args.results)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
