"""What the jobs write: Parquet frames, metrics as CSV, a model and metadata as JSON."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from datetime import datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import content_digest
from ..operators import forecasting as Y


FOLDER_VARIABLE = "ALARMLOOM_ARTIFACTS"
CORE = ("events.parquet", "incidents.parquet", "incident_events.parquet", "forecast_model.json")


def artifact_folder(root: str | Path) -> Path:
    """The folder that the environment names, else the processed data if it is whole, else what is deployed."""
    named = os.environ.get(FOLDER_VARIABLE)
    if named:
        return Path(root) / named  # an absolute name stands for itself
    own = Path(root) / "data" / "processed"
    return own if all((own / name).exists() for name in CORE) else Path(root) / "data" / "deployment"


def missing_artifacts(root: str | Path) -> list[str]:
    return [name for name in CORE if not (artifact_folder(root) / name).exists()]


def file_sha256(path: str | Path) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as file:
        while chunk := file.read(1 << 20):
            digest.update(chunk)
    return digest.hexdigest()


def commit_of(folder: str | Path = ".") -> str | None:
    try:
        return subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True, check=True).stdout.strip()
    except (OSError, subprocess.CalledProcessError):
        return None


def write_frame(df: DataFrame, path: str) -> None:
    """Parquet with zstd, in as many files as the frame has partitions."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_json(data: Any, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")


def write_metrics(df: DataFrame, path: str | Path) -> None:
    """A small result (a row a configuration) as one CSV file with line feeds."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    df.toPandas().to_csv(path, index=False, lineterminator="\n")


def checked_time(generated: datetime) -> str:
    if generated.tzinfo is None:
        raise ValueError("the time of generation must have a zone")
    return generated.isoformat()


def split_ranges(df: DataFrame, time: str = "timestamp") -> dict[str, dict[str, Any]]:
    rows = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("low"), F.max(time).alias("high")).collect()  # a row a split
    return {r.split: {"row_count": r.n, "minimum_timestamp": r.low.isoformat(), "maximum_timestamp": r.high.isoformat()} for r in rows}


def events_metadata(events: DataFrame, source: str, settings: dict[str, Any], generated: datetime) -> dict[str, Any]:
    return {
        "source_path": source,
        "source_sha256": file_sha256(source) if Path(source).is_file() else None,
        "settings": settings,
        "git_commit": commit_of(),
        "generated_at": checked_time(generated),
        "row_count": events.count(),
        "schema": dict(events.dtypes),
        "splits": split_ranges(events),
    }


def result_metadata(metrics: DataFrame, sources: dict[str, str], settings: dict[str, Any], split: str, generated: datetime, **more: Any) -> dict[str, Any]:
    """What stands beside a result file: where it comes from, with which settings and code, and what it holds."""
    return {
        "git_commit": commit_of(),
        "generated_at": checked_time(generated),
        "evaluation_split": split,
        "is_final_test": split == "test",
        "sources": {name: {"path": path, "sha256": content_digest(metrics.sparkSession, path)} for name, path in sources.items()},
        "settings": settings,
        "result_rows": metrics.count(),
        "schema": dict(metrics.dtypes),
        **more,
    }


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A result file written by ``write_metrics``."""
    return spark.read.csv(path, header=True, inferSchema=True)


def evaluation_tables(spark: SparkSession, results: str) -> dict[str, DataFrame]:
    """The locked results that an evaluation page shows, checked: one test row each, and all support groups."""
    names = {"retrieval": "retrieval_test_results", "forecast": "forecast_test_results", "groups": "forecast_test_support_groups"}
    found = {k: read_metrics(spark, f"{results}/{n}.csv") for k, n in names.items()}
    check_evaluation(found["retrieval"], found["forecast"], found["groups"])
    return found


def check_validation(metrics: DataFrame) -> None:
    if {r[0] for r in metrics.select("selection_split").distinct().limit(3).collect()} != {"validation"}:
        raise ValueError("only validation results may be written here")


def check_locked_test(metrics: DataFrame, column: str = "split") -> None:
    rows = metrics.select(column).limit(2).collect()
    if len(rows) != 1 or rows[0][0] != "test":
        raise ValueError("a locked result has one row, of the test split")


def check_evaluation(retrieval: DataFrame, forecast: DataFrame, groups: DataFrame) -> None:
    """One locked row each, on test, and all three support groups."""
    check_locked_test(retrieval, "selection_split" if "selection_split" in retrieval.columns else "split")
    check_locked_test(forecast)
    if sorted(r[0] for r in groups.select("support_group").limit(4).collect()) != sorted(Y.GROUPS):
        raise ValueError("the support groups must be rare, medium and common")


# ---------------------------------------------------------------- portable model


def model_json(labels: DataFrame, least_machine: int, least_transition: int) -> dict[str, Any]:
    """The transition model as plain data. Its size is that of the model: scopes with enough samples, times codes."""
    overall = Y.fit_global(labels).orderBy("alarm_code").collect()
    codes = [r.alarm_code for r in overall]

    def vectors(df: DataFrame, keys: tuple[str, ...], least: int) -> list[dict[str, Any]]:
        rows = df.where(F.col("samples") >= least).groupBy(*keys, "samples").agg(F.array_sort(F.collect_list(F.struct("alarm_code", "score"))).alias("x")).orderBy(*keys).collect()
        return [{**{k: r[k] for k in keys}, "samples": r.samples, "scores": [x.score for x in r.x]} for r in rows]

    return {
        "model_version": Y.TRANSITION,
        "alarm_codes": codes,
        "global_scores": [r.score for r in overall],
        "machines": vectors(Y.fit_machine(labels), ("machine_id",), least_machine),
        "transitions": vectors(Y.fit_transition(labels), ("machine_id", "last_alarm_code"), least_transition),
    }


class RuntimeModel:
    """A model read back from JSON; scores one episode without a session."""

    def __init__(self, data: dict[str, Any]):
        self.codes = [str(c) for c in data["alarm_codes"]]
        if len(set(self.codes)) != len(self.codes) or not self.codes:
            raise ValueError("alarm codes must be there and differ")
        self.version = str(data["model_version"])
        self.overall = self.checked(data["global_scores"], "global_scores")
        self.machines = {m["machine_id"]: (self.checked(m["scores"], "machines"), int(m["samples"])) for m in data["machines"]}
        self.states = {(t["machine_id"], t["last_alarm_code"]): (self.checked(t["scores"], "transitions"), int(t["samples"])) for t in data["transitions"]}

    @classmethod
    def read(cls, path: str | Path) -> RuntimeModel:
        return cls(json.loads(Path(path).read_text(encoding="utf-8")))

    def checked(self, scores: list, name: str) -> list[float]:
        values = [float(s) for s in scores]
        if len(values) != len(self.codes):
            raise ValueError(f"{name} must have a score for each code")
        if not all(0 <= v <= 1 for v in values):
            raise ValueError(f"{name} must lie between 0 and 1")
        return values

    def predict(self, machine_id: str, last_code: str, k: int = 5, hours: float = 6.0) -> list[dict[str, Any]]:
        if k < 1 or not 0 < hours < float("inf"):
            raise ValueError("k and the horizon must be above zero")
        if (machine_id, last_code) in self.states:
            (scores, support), scope = self.states[machine_id, last_code], "transition"
        elif machine_id in self.machines:
            (scores, support), scope = self.machines[machine_id], "machine_fallback"
        else:
            scores, support, scope = self.overall, sum(n for _, n in self.machines.values()), "global_fallback"
        order = sorted(range(len(self.codes)), key=lambda i: (-scores[i], self.codes[i]))[:k]
        return [
            {"rank": r, "alarm_code": self.codes[i], "model_score": scores[i], "model_version": self.version, "forecast_horizon_hours": float(hours), "baseline_scope": scope, "train_support": support}
            for r, i in enumerate(order, 1)
        ]
