"""A gated recurrent model of alarm sequences in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forecasting import complete_train, fit_vocabulary
from .sequences import FIRST_TOKEN, encode, fit as fit_numbers

MODES = ("none", "balanced_capped")
#: Their first rows stand for padding and for machines that are not known: zero, and never learnt.
PADDED = ("token", "machine")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Gru:
    """Token embedding, one gated layer, machine embedding, a logit a code; trained by Adam on mean cross-entropy."""

    def __init__(self, tokens: int, machines: int, codes: int, size: int, hidden: int, machine_size: int, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {
            "token": rng.normal(0, 0.1, (tokens, size)), "machine": rng.normal(0, 0.1, (machines, machine_size)), "wx": rng.normal(0, size**-0.5, (size, 3 * hidden)),
            "wh": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden), "out": rng.normal(0, hidden**-0.5, (hidden + machine_size, codes)), "bias": np.zeros(codes),
        }
        for name in PADDED:
            self.p[name][0] = 0
        self.hidden = hidden
        self.m, self.v, self.t = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0

    def run(self, ids: np.ndarray, lengths: np.ndarray, machines: np.ndarray):
        p, n, h = self.p, self.hidden, np.zeros((len(ids), self.hidden))
        trace = []
        for t in range(ids.shape[1]):
            x, live = p["token"][ids[:, t]], (t < lengths)[:, None]
            gx, gh = x @ p["wx"] + p["b"], h @ p["wh"]
            z, r = sigmoid(gx[:, :n] + gh[:, :n]), sigmoid(gx[:, n : 2 * n] + gh[:, n : 2 * n])
            c = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
            new = np.where(live, (1 - z) * c + z * h, h)
            trace.append((x, h, z, r, c, gh[:, 2 * n :], live))
            h = new
        both = np.concatenate([h, p["machine"][machines]], axis=1)
        return sigmoid(both @ p["out"] + p["bias"]), both, trace

    def step(self, ids, lengths, machines, y, weight, rate: float) -> None:
        p, n = self.p, self.hidden
        score, both, trace = self.run(ids, lengths, machines)
        d = (np.where(y > 0, weight, 1.0) * (score - y)) / y.size
        g = {k: np.zeros_like(x) for k, x in p.items()}
        g["out"], g["bias"] = both.T @ d, d.sum(0)
        back = d @ p["out"].T
        np.add.at(g["machine"], machines, back[:, n:])
        dh = back[:, :n]
        for t in range(ids.shape[1] - 1, -1, -1):
            x, h, z, r, c, ghc, live = trace[t]
            own = np.where(live, dh, 0)
            dc = own * (1 - z) * (1 - c * c)
            dz, dr = own * (h - c) * z * (1 - z), dc * ghc * r * (1 - r)
            gate, into = np.concatenate([dz, dr, dc], 1), np.concatenate([dz, dr, dc * r], 1)
            g["wx"] += x.T @ gate
            g["b"] += gate.sum(0)
            g["wh"] += h.T @ into
            np.add.at(g["token"], ids[:, t], gate @ p["wx"].T)
            dh = np.where(live, own * z + into @ p["wh"].T, dh)
        for name in PADDED:
            g[name][0] = 0
        self.t += 1
        for k in p:
            self.m[k] = 0.9 * self.m[k] + 0.1 * g[k]
            self.v[k] = 0.999 * self.v[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def score_gru(documents: DataFrame, labels: DataFrame, length: int = 64, size: int = 24, hidden: int = 48, machine_size: int = 8, batch: int = 256, epochs: int = 8, rate: float = 1e-3, mode: str = "none", cap: float = 20.0, seed: int = 0, most_samples: int = 50_000) -> DataFrame:
    """(incident_id, alarm_code, score) of all episodes. The model is fitted on the driver from at most
    ``most_samples`` complete train episodes, the first by hash, and scores where the rows are."""
    if mode not in MODES:
        raise ValueError("the weight must be none or balanced_capped")
    numbers = fit_numbers(documents)
    rows = encode(documents, numbers, length)
    codes = [r.alarm_code for r in fit_vocabulary(labels).orderBy("alarm_code").collect()]
    place = {c: i for i, c in enumerate(codes)}
    chosen = complete_train(labels).orderBy(F.xxhash64("incident_id"), "incident_id").limit(most_samples).select("incident_id", "future_alarm_codes")
    held = chosen.join(rows, "incident_id").orderBy("incident_id").toPandas()  # most_samples rows at most
    y = np.zeros((len(held), max(1, len(codes))))
    for i, found in enumerate(held["future_alarm_codes"]):
        y[i, [place[c] for c in found if c in place]] = 1
    model = Gru(len(numbers.tokens) + FIRST_TOKEN, len(numbers.machines) + 1, max(1, len(codes)), size, hidden, machine_size, seed)
    if len(held):
        ids, lengths, machines = np.array(held["token_ids"].tolist()), held["sequence_length"].to_numpy(), held["machine_number"].to_numpy()
        hits = y.sum(0)
        weight = np.clip((len(y) - hits) / np.maximum(hits, 1), 1, cap) if mode == "balanced_capped" else np.ones(y.shape[1])
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(held))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                longest = int(lengths[at].max())
                model.step(ids[at, :longest], lengths[at], machines[at], y[at], weight, rate)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(frames):
        for frame in frames:
            if len(frame) and codes:
                ids, lengths = np.array(frame["token_ids"].tolist()), frame["sequence_length"].to_numpy()
                p, _, _ = shared.value.run(ids[:, : max(1, int(lengths.max()))], lengths, frame["machine_number"].to_numpy())
                yield pd.DataFrame({"incident_id": np.repeat(frame["incident_id"].to_numpy(), len(codes)), "alarm_code": codes * len(frame), "score": p.ravel()})

    return rows.select("incident_id", "token_ids", "sequence_length", "machine_number").mapInPandas(score, "incident_id string, alarm_code string, score double")
