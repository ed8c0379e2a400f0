"""Bundles of frames and settings that are committed at once, digests of what is stored, and loaders that keep frames until a file changes.

Parts of a new state of a bundle are written below a folder of their own. Only when all are there is a manifest written that names
them with their digests; its name is put in place by one rename. Readers go by the manifest with the largest number, so they see
either all parts of one state or all of another, and a job that breaks off leaves the state before.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import content_digest, place
from ..operators import features as X
from ..operators import forecasting as Y
from ..operators import windows as W
from ..operators.investigation import Investigator
from .artifacts import write_frame

class Bundle:
    """A folder of states; ``with bundle.change() as new`` commits what is put into ``new`` together, over the parts there were."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def manifests(self) -> list[str]:
        system, held = place(self.spark, self.root)
        names = [s.getPath().getName() for s in system.listStatus(held)] if system.exists(held) else []
        return sorted(n for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self) -> dict[str, dict[str, Any]]:
        """name -> path (below the root), kind and sha256 of each part."""
        names = self.manifests()
        if not names:
            return {}
        return json.loads(self.spark.read.text(f"{self.root}/{names[-1]}", wholetext=True).first()[0])

    def change(self) -> Change:
        return Change(self)

    def path(self, name: str) -> str:
        parts = self.manifest()
        if name not in parts:
            raise KeyError(f"the bundle {self.root} has no part {name}")
        return f"{self.root}/{parts[name]['path']}"

    def frame(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def data(self, name: str) -> Any:
        return json.loads(self.spark.read.text(self.path(name), wholetext=True).first()[0])

    def damaged(self) -> list[str]:
        """Parts whose files are not those that the manifest names."""
        return [n for n, part in self.manifest().items() if content_digest(self.spark, f"{self.root}/{part['path']}") != part["sha256"]]


class Change:
    """A new state of a bundle, seen by nobody until it is committed."""

    def __init__(self, bundle: Bundle):
        self.bundle, self.folder, self.parts = bundle, f"states/{uuid.uuid4().hex}", {}

    def frame(self, name: str, df: DataFrame) -> DataFrame:
        """Writes a frame and gives it back as written, for the parts that follow from it."""
        path = f"{self.bundle.root}/{self.folder}/{name}.parquet"
        write_frame(df, path)
        self.parts[name] = "parquet"
        return self.bundle.spark.read.parquet(path)

    def data(self, name: str, value: Any) -> None:
        self.write(f"{self.folder}/{name}.json", json.dumps(value, ensure_ascii=False, indent=2, default=str))
        self.parts[name] = "json"

    def write(self, path: str, text: str) -> None:
        system, held = place(self.bundle.spark, f"{self.bundle.root}/{path}")
        out = system.create(held, False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    def __enter__(self) -> Change:
        return self

    def __exit__(self, kind, value, trace) -> None:
        bundle = self.bundle
        system, folder = place(bundle.spark, f"{bundle.root}/{self.folder}")
        if kind is not None:
            system.delete(folder, True)
            return
        before = bundle.manifest()
        own = {n: {"path": f"{self.folder}/{n}.{k}", "kind": k, "sha256": content_digest(bundle.spark, f"{bundle.root}/{self.folder}/{n}.{k}")} for n, k in self.parts.items()}
        number = int(bundle.manifests()[-1][9:-5]) + 1 if before else 1
        staged = f"{self.folder}/manifest.json"
        self.write(staged, json.dumps({**before, **own}, indent=2))
        final = place(bundle.spark, f"{bundle.root}/manifest-{number:09}.json")[1]
        # a rename puts the manifest there whole; of two at once one finds the name taken
        if system.exists(final) or not system.rename(place(bundle.spark, f"{bundle.root}/{staged}")[1], final):
            system.delete(folder, True)
            raise RuntimeError(f"another change of {bundle.root} was committed meanwhile")
        self.forget()

    def forget(self) -> None:
        """Deletes states that neither the newest manifest nor the one before names; readers of that one may still be at work."""
        bundle, names = self.bundle, self.bundle.manifests()
        system, states = place(bundle.spark, f"{bundle.root}/states")
        held = [json.loads(bundle.spark.read.text(f"{bundle.root}/{n}", wholetext=True).first()[0]) for n in names[-2:]]
        used = {part["path"].split("/")[1] for parts in held for part in parts.values()}
        for name in names[:-2]:
            system.delete(place(bundle.spark, f"{bundle.root}/{name}")[1], False)
        if len(names) > 2:
            for status in system.listStatus(states):
                if status.getPath().getName() not in used:
                    system.delete(status.getPath(), True)


@dataclass
class Loader:
    """Frames of a bundle, kept in Spark's cache and given up when a digest in the manifest they were made from has changed."""

    bundle: Bundle
    held: dict[str, tuple[tuple[str, ...], DataFrame]] = field(default_factory=dict)

    def frame(self, name: str) -> DataFrame:
        return self.made(name, (name,), lambda: self.bundle.frame(name))

    def made(self, name: str, parts: tuple[str, ...], make) -> DataFrame:
        """What ``make`` gives from ``parts``: made once, and again after one of them has changed."""
        manifest = self.bundle.manifest()
        key = tuple(manifest[p]["sha256"] if p in manifest else "" for p in parts)
        if name in self.held:
            known, df = self.held[name]
            if known == key:
                return df
            df.unpersist()
        df = make().persist(StorageLevel.MEMORY_AND_DISK)
        self.held[name] = key, df
        return df


PARTS = ("events", "incidents", "incident_events")


def write_investigation_bundle(bundle: Bundle, events: DataFrame, incidents: DataFrame, mapping: DataFrame) -> None:
    with bundle.change() as new:
        for name, df in zip(PARTS, (events, incidents, mapping)):
            new.frame(name, df)


def load_investigation_resources(loader: Loader, hours: float = 6.0, least_machine: int = 200, least_transition: int = 20) -> Investigator:
    """All that investigations read, from a bundle of PARTS. A second call scans nothing; after a change only what depends on it is made again."""
    events, incidents, mapping = (loader.frame(n) for n in PARTS)

    def documents() -> DataFrame:
        return X.alarm_documents(mapping, events).join(incidents.select("incident_id", "split", "machine_id"), "incident_id")

    def labels() -> DataFrame:
        return Y.with_context(W.forecast_labels(incidents, events, hours), incidents.select("incident_id", "last_alarm_code"))

    docs = loader.made("documents", PARTS, documents)
    vectors = loader.made("vectors", PARTS, lambda: X.feature_vectors(incidents, docs))
    outcomes = loader.made(f"outcomes-{hours}", PARTS[:2], lambda: W.future_outcomes(incidents, events, hours))
    return Investigator(incidents, events, docs, vectors, outcomes, loader.made(f"labels-{hours}", PARTS[:2], labels), least_machine, least_transition)
