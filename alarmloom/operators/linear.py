"""One logistic model a code on TF-IDF and shape, and a small recurrent model in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import feature_vectors
from .forecasting import complete_train, fit_vocabulary

WEIGHTS = ("none", "balanced")


def feature_columns(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(incident_id, names, values): the vectors as pairs of arrays, shape as three names of its own."""
    shape = F.array(*(F.struct(F.lit(f"__shape_{i}").alias("token"), F.col("shape")[i].alias("weight")) for i in range(3)))
    return vectors.join(labels.select("incident_id"), "incident_id", "left_semi").select("incident_id", F.concat("terms", shape).alias("x"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float, steps: int) -> np.ndarray:
    """Weights that minimise |w|^2 / 2 + C * loss, the constant among them, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = w + c * x.T @ (weight * (p - y))
        hessian = np.eye(len(w)) + c * (x * (weight * p * (1 - p))[:, None]).T @ x
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def score_linear(episodes: DataFrame, documents: DataFrame, labels: DataFrame, c: float = 1.0, max_iter: int = 300, class_weight: str = "none", most_samples: int = 50_000) -> DataFrame:
    """(incident_id, alarm_code, score) of all episodes for each code of the vocabulary.

    A code's model is fitted in a task of its own from at most ``most_samples`` complete train
    episodes, the first by hash, and then scores all episodes where they are; a code that all or none of the samples have gets that
    constant. ``balanced`` weighs classes by n / (2 n_class).
    """
    if class_weight not in WEIGHTS:
        raise ValueError("the class weight must be none or balanced")
    rows = feature_columns(feature_vectors(episodes, documents), labels)
    sample = complete_train(labels).orderBy(F.xxhash64("incident_id"), "incident_id").limit(most_samples).select("incident_id", "future_alarm_codes").join(rows, "incident_id")
    held = sample.toPandas()  # most_samples rows at most
    names = sorted({t["token"] for x in held["x"] for t in x})
    place = {n: i for i, n in enumerate(names)}

    def matrix(xs) -> np.ndarray:
        out = np.zeros((len(xs), len(place) + 1))
        out[:, -1] = 1
        for i, x in enumerate(xs):
            for t in x:
                if (k := place.get(t["token"])) is not None:
                    out[i, k] = t["weight"]
        return out

    spark = episodes.sparkSession
    shared = spark.sparkContext.broadcast((matrix(held["x"]), [set(v) for v in held["future_alarm_codes"]]))

    def fit(frames):
        x, truths = shared.value
        for frame in frames:
            for code in frame["alarm_code"]:
                y = np.array([code in t for t in truths], float)
                if y.min(initial=1) == y.max(initial=0):
                    yield pd.DataFrame({"alarm_code": [code], "weights": [None], "constant": [float(y.mean()) if len(y) else 0.0]})
                    continue
                weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))) if class_weight == "balanced" else np.ones(len(y))
                yield pd.DataFrame({"alarm_code": [code], "weights": [logistic(x, y, weight, c, max_iter)], "constant": [None]})

    vocabulary = fit_vocabulary(labels).select("alarm_code")
    fitted = vocabulary.repartition("alarm_code").mapInPandas(fit, "alarm_code string, weights array<double>, constant double").toPandas()  # a row a code
    models = spark.sparkContext.broadcast((fitted["alarm_code"].tolist(), np.array([w if w is not None else np.zeros(len(place) + 1) for w in fitted["weights"]]).reshape(len(fitted), -1), fitted["constant"].to_numpy(float)))

    def score(frames):
        codes, w, constant = models.value
        for frame in frames:
            p = 1 / (1 + np.exp(-np.clip(matrix(frame["x"]) @ w.T, -35, 35))) if len(codes) else np.zeros((len(frame), 0))
            p = np.where(np.isnan(constant)[None, :], p, np.nan_to_num(constant)[None, :])
            yield pd.DataFrame({"incident_id": np.repeat(frame["incident_id"].to_numpy(), len(codes)), "alarm_code": codes * len(frame), "score": p.ravel()})

    return rows.mapInPandas(score, "incident_id string, alarm_code string, score double")
