"""Settings from TOML, checked."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from math import isclose, isfinite
from pathlib import Path
from typing import Any

from ..operators.features import ALARM_VERSION, COMBINED_VERSION
from ..operators.forecasting import COMPLEXITY
from ..operators.retrieval import POLICIES


class SettingsError(ValueError):
    pass


def load(path: str | Path) -> dict[str, Any]:
    with open(path, "rb") as file:
        return tomllib.load(file)


def need(ok: bool, text: str) -> None:
    if not ok:
        raise SettingsError(text)


def number(x: Any) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool) and isfinite(x)


def rising(values: tuple, low: float, high: float = float("inf")) -> bool:
    return bool(values) and all(number(v) and low < v <= high for v in values) and len(set(values)) == len(values)


@dataclass(frozen=True)
class Incidents:
    gap_minutes: float = 30
    sensitivity_gap_minutes: tuple[float, ...] = (15, 30, 60)

    def __post_init__(self):
        need(number(self.gap_minutes) and self.gap_minutes > 0, "incidents.gap_minutes must be above zero")
        need(rising(self.sensitivity_gap_minutes, 0), "incidents.sensitivity_gap_minutes must be different numbers above zero")


@dataclass(frozen=True)
class Baselines:
    quantile: float = 0.95
    minimum_incident_count: int = 200

    def __post_init__(self):
        need(number(self.quantile) and 0 < self.quantile < 1, "baselines.quantile must lie between 0 and 1")
        need(isinstance(self.minimum_incident_count, int) and self.minimum_incident_count > 0, "baselines.minimum_incident_count must be above zero")


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 5
    alarm_weight: float = 1.0
    shape_weight: float = 1.0
    candidate_policy: str = "expanding_history"
    future_horizon_hours_candidates: tuple[float, ...] = (1, 6, 24)
    relevance_threshold_candidates: tuple[float, ...] = (0.1, 0.3, 0.5)
    selected_feature_version: str | None = None
    future_horizon_hours: float | None = None
    relevance_threshold: float | None = None

    def __post_init__(self):
        need(isinstance(self.top_k, int) and self.top_k > 0, "retrieval.top_k must be above zero")
        need(all(number(w) and w >= 0 for w in (self.alarm_weight, self.shape_weight)) and self.alarm_weight + self.shape_weight > 0, "retrieval weights must not be negative, nor both zero")
        need(self.candidate_policy in POLICIES, "retrieval.candidate_policy is unknown")
        need(rising(self.future_horizon_hours_candidates, 0), "retrieval horizons must be different numbers above zero")
        need(rising(self.relevance_threshold_candidates, 0, 1), "retrieval thresholds must be different numbers above 0, at most 1")
        chosen = (self.selected_feature_version, self.future_horizon_hours, self.relevance_threshold)
        need(all(c is None for c in chosen) or all(c is not None for c in chosen), "the selected settings of retrieval go together")
        if chosen[0] is not None:
            need(chosen[0] in (ALARM_VERSION, COMBINED_VERSION), "retrieval.selected_feature_version is unknown")
            need(chosen[1] in self.future_horizon_hours_candidates, "retrieval.future_horizon_hours is not among the candidates")
            need(chosen[2] in self.relevance_threshold_candidates, "retrieval.relevance_threshold is not among the candidates")


@dataclass(frozen=True)
class Forecasting:
    top_k: int = 5
    forecast_horizon_hours_candidates: tuple[float, ...] = (1, 6, 24)
    selected_forecast_horizon_hours: float = 6
    rare_max_train_support: int = 49
    common_min_train_support: int = 500
    minimum_machine_train_samples: int = 200
    minimum_transition_train_samples: int = 20
    linear_c: float = 1.0
    linear_max_iter: int = 300
    linear_class_weight_candidates: tuple[str, ...] = ("none", "balanced")
    sequence_max_length: int = 64
    sequence_embedding_dim: int = 24
    sequence_hidden_dim: int = 48
    sequence_machine_embedding_dim: int = 8
    sequence_batch_size: int = 256
    sequence_epochs: int = 8
    sequence_learning_rate: float = 0.001
    sequence_weight_candidates: tuple[str, ...] = ("none", "balanced_capped")
    sequence_positive_weight_cap: float = 20.0
    random_seed: int = 0
    selection_macro_f1_tolerance: float = 0.01
    selected_model_version: str = "transition_frequency_v1"

    def __post_init__(self):
        whole = ("top_k", "rare_max_train_support", "common_min_train_support", "minimum_machine_train_samples", "minimum_transition_train_samples", "linear_max_iter", "sequence_max_length", "sequence_embedding_dim", "sequence_hidden_dim", "sequence_machine_embedding_dim", "sequence_batch_size", "sequence_epochs")
        for name in whole:
            need(isinstance(getattr(self, name), int) and getattr(self, name) > 0, f"forecasting.{name} must be a whole number above zero")
        for name in ("linear_c", "sequence_learning_rate"):
            need(number(getattr(self, name)) and getattr(self, name) > 0, f"forecasting.{name} must be above zero")
        need(rising(self.forecast_horizon_hours_candidates, 0), "forecasting horizons must be different numbers above zero")
        need(self.selected_forecast_horizon_hours in self.forecast_horizon_hours_candidates, "forecasting.selected_forecast_horizon_hours is not among the candidates")
        need(self.common_min_train_support > self.rare_max_train_support + 1, "forecasting support bounds leave no medium codes")
        need(set(self.linear_class_weight_candidates) <= {"none", "balanced"}, "forecasting.linear_class_weight_candidates are unknown")
        need(set(self.sequence_weight_candidates) <= {"none", "balanced_capped"}, "forecasting.sequence_weight_candidates are unknown")
        need(number(self.sequence_positive_weight_cap) and self.sequence_positive_weight_cap >= 1, "forecasting.sequence_positive_weight_cap must be at least 1")
        need(isinstance(self.random_seed, int) and self.random_seed >= 0, "forecasting.random_seed must not be negative")
        need(number(self.selection_macro_f1_tolerance) and self.selection_macro_f1_tolerance >= 0, "forecasting.selection_macro_f1_tolerance must not be negative")
        need(self.selected_model_version in COMPLEXITY, "forecasting.selected_model_version is unknown")


@dataclass(frozen=True)
class Split:
    strategy: str = "per_machine_unique_timestamp"
    train_ratio: float = 0.70
    validation_ratio: float = 0.15
    test_ratio: float = 0.15

    def __post_init__(self):
        shares = (self.train_ratio, self.validation_ratio, self.test_ratio)
        need(all(number(s) and s > 0 for s in shares) and isclose(sum(shares), 1.0), "split shares must be above zero and sum to one")


@dataclass(frozen=True)
class Settings:
    incidents: Incidents = Incidents()
    baselines: Baselines = Baselines()
    retrieval: Retrieval = Retrieval()
    forecasting: Forecasting = Forecasting()
    split: Split = Split()


def parse(data: dict[str, Any]) -> Settings:
    """Sections and keys that are missing have their defaults; unknown ones raise."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    need(set(data) <= set(kinds), f"unknown sections: {sorted(set(data) - set(kinds))}")
    made = {}
    for name, kind in kinds.items():
        section = data.get(name, {})
        known = {f.name for f in fields(kind)}
        need(set(section) <= known, f"unknown keys in {name}: {sorted(set(section) - known)}")
        made[name] = kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in section.items()})
    return Settings(**made)
