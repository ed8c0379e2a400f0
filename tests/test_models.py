"""The linear and the recurrent model: gradients, held-out accuracy, constants."""

import numpy as np
import pytest

from alarmloom.operators.linear import logistic, score_linear
from alarmloom.operators.recurrent import Gru, score_gru

LABELS = "incident_id string, machine_id string, split string, outcome_is_complete boolean, future_alarm_codes array<string>"


def frames(spark, n=160):
    """The code that follows is the one that ended the episode; every episode is also followed by 9."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(n):
        codes = [str(c) for c in rng.integers(1, 4, 3)]
        rows.append((f"i{i:03d}", "4", "train" if i < n * 3 // 4 else "test", " ".join([*codes, codes[-1], codes[-1]]), codes[-1]))
    episodes = spark.createDataFrame([(i, m, s, 5, 1.0, 3) for i, m, s, _, _ in rows], "incident_id string, machine_id string, split string, event_count long, duration_seconds double, distinct_alarm_count long")
    documents = spark.createDataFrame([(i, s, m, d) for i, m, s, d, _ in rows], "incident_id string, split string, machine_id string, alarm_document string")
    labels = spark.createDataFrame([(i, m, s, True, sorted([last, "9"])) for i, m, s, _, last in rows], LABELS)
    return episodes, documents, labels, {i: last for i, _, s, _, last in rows if s == "test"}


def best(scores, truth):
    rows = scores.where("alarm_code <> '9'").toPandas()
    top = rows.sort_values("score").groupby("incident_id").last()["alarm_code"]
    return np.mean([top[i] == c for i, c in truth.items()])


def test_logistic_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, y, weight = rng.normal(size=(80, 4)), rng.integers(0, 2, 80).astype(float), rng.uniform(0.5, 2, 80)
    w = logistic(x, y, weight, 1.3, 100)
    gradient = w + 1.3 * x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - y))
    assert np.abs(gradient).max() < 1e-6


@pytest.mark.parametrize("class_weight", ["none", "balanced"])
def test_linear_on_held_out_episodes(spark, class_weight):
    episodes, documents, labels, truth = frames(spark)
    scores = score_linear(episodes, documents, labels, class_weight=class_weight)
    assert best(scores, truth) > 0.85
    assert {r.score for r in scores.where("alarm_code = '9'").collect()} == {1.0}
    with pytest.raises(ValueError):
        score_linear(episodes, documents, labels, class_weight="x")


def test_gru_gradients():
    rng = np.random.default_rng(2)
    model = Gru(6, 3, 4, 3, 5, 2, 7)
    ids, lengths, machines, y = rng.integers(1, 6, (4, 5)), np.array([5, 3, 1, 4]), np.array([0, 1, 2, 1]), rng.integers(0, 2, (4, 4)).astype(float)
    weight = np.array([1.0, 2.0, 3.0, 1.5])

    def loss():
        p, _, _ = model.run(ids, lengths, machines)
        return -np.mean(np.where(y > 0, weight * np.log(p), np.log(1 - p)))

    before = {k: v.copy() for k, v in model.p.items()}
    model.step(ids, lengths, machines, y, weight, 0.0)
    for name in model.p:
        gradient = model.m[name] / 0.1
        for _ in range(5):
            at = tuple(rng.integers(0, n) for n in model.p[name].shape)
            if name in ("token", "machine") and at[0] == 0:
                assert gradient[at] == 0 and before[name][at] == 0  # padding and machines that are not known
                continue
            sides = []
            for move in (1e-5, -1e-5):
                model.p[name][at] = before[name][at] + move
                sides.append(loss())
            model.p[name][at] = before[name][at]
            assert gradient[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_gru_on_held_out_episodes(spark):
    _, documents, labels, truth = frames(spark)
    scores = score_gru(documents, labels, length=4, size=8, hidden=16, batch=16, epochs=60, rate=0.02)
    assert best(scores, truth) > 0.9
    assert all(0 <= r.score <= 1 for r in scores.collect())
    with pytest.raises(ValueError):
        score_gru(documents, labels, mode="x")


def test_gru_query_trains_the_production_epochs(monkeypatch):
    import inspect
    from types import SimpleNamespace

    from alarmloom.operators import recurrent
    from alarmloom.plans import forecast_queries
    from alarmloom.plans.settings import Forecasting

    signature, seen = inspect.signature(score_gru), []

    def spy(*args, **named):
        bound = signature.bind(*args, **named)
        bound.apply_defaults()
        seen.append(bound.arguments["epochs"])

    monkeypatch.setattr(recurrent, "score_gru", spy)
    monkeypatch.setattr(forecast_queries, "Forecast", lambda *_: SimpleNamespace(inputs=SimpleNamespace(documents=None), labels=None))
    forecast_queries.gru(None, "")
    assert seen == [Forecasting().sequence_epochs]
