"""Centroid clustering of integer vectors with Elkan's bounds.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of that to
each centroid. They are moved along with the centroids, and a distance is worked out only where neither the
lower bound nor half the distance between two centroids is strictly above the upper bound. Bounds
are doubles rounded to the safe side, and only strict comparisons rule a centroid out, so a tie is
always decided by exact integers. Centroids follow from sums that change by the vectors that have moved
alone. Vectors and bounds of a round are stored; a round reads those of the one before.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored

SCALE, DIMENSIONS, CENTROIDS, ROUNDS, SEED = 1024.0, 64, 8, 10, 3
#: Components up to this size are worked on as 64-bit integers: squared distances of 64 components stay below 2 ** 62.
SMALL = 1 << 27
#: Bits of a part of a sum, which may be larger than a long.
PART = 40
ROUNDING = 4e-15
LARGEST = (1 << 63) - 1
STATE = "vec_id long, vector array<double>, cluster int, upper double, lower array<double>, dim int, part int, value long"
KINDS = pa.schema(
    [("vec_id", pa.int64()), ("vector", pa.list_(pa.float64())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("dim", pa.int32()), ("part", pa.int32()), ("value", pa.int64())]
)


def kept_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id and the vector of floor(1024 * x), exact integers held as doubles, of the rows that take part.

    Those have exactly ``dimensions`` components, none null, none without a finite product.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf")) & ~F.isnan(x))
    held = vectors.where(F.col("embedding").isNotNull()).where((F.size("embedding") == dimensions) & finite)
    # a double's floor is a long in Spark, too short for the largest; those are whole numbers already
    whole = F.transform("embedding", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    return held.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vector"))


def first_centroids(kept: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hash of vec_id, in its order; equal ids by vector, null last."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "vector").limit(count).collect()
    return [[int(x) for x in r.vector] for r in rows]


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances; both are of int64, or both of Python's integers."""
    return ((points - centre) ** 2).sum(axis=1)


def roots(squared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Doubles not above and not below the square roots."""
    if squared.dtype != object:
        near = np.sqrt(squared.astype(np.float64))
        return near * (1 - ROUNDING), near * (1 + ROUNDING)
    low, high = np.zeros(len(squared)), np.full(len(squared), np.inf)
    for i, x in enumerate(squared):
        root = math.isqrt(int(x))
        try:
            low[i], high[i] = float(root) * (1 - ROUNDING), float(root + 1) * (1 + ROUNDING)
        except OverflowError:
            low[i] = np.finfo(float).max / 2
    return low, high


def as_integers(vectors: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and centroids as int64 where that is exact, else as Python's integers."""
    if np.abs(vectors).max(initial=0) <= SMALL and all(abs(x) <= SMALL for c in centres for x in c):
        return vectors.astype(np.int64), np.array(centres, np.int64)
    exact = np.array([[int(x) for x in v] for v in vectors.tolist()], object).reshape(vectors.shape)
    return exact, np.array(centres, object)


class Centroids:
    """The centroids of a round, half the distances between them and how far each has moved since the round before."""

    def __init__(self, centres: list[list[int]], before: list[list[int]] | None = None):
        self.centres = centres
        exact = np.array(centres, object)
        self.half = np.stack([roots(squares(exact, c))[0] / 2 for c in exact])
        self.moved = np.array([roots(squares(exact[i : i + 1], np.array(before[i], object)))[1][0] for i in range(len(centres))]) if before else np.zeros(len(centres))


def assign(points: np.ndarray, centres: np.ndarray, held: Centroids, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (ties: the smaller number) of ``points``, with their new bounds, and how many distances were worked out.

    ``own`` is -1 where there is no centroid yet.
    """
    own, worked = own.copy(), 0
    fresh = own < 0
    own[fresh] = 0
    upper = np.where(fresh, np.inf, (upper + held.moved[own]) * (1 + ROUNDING))
    lower = np.where(fresh[:, None], 0.0, np.maximum(0.0, (lower - held.moved) - ROUNDING * (lower + held.moved)))
    exact = np.zeros(len(points), points.dtype)  # squared distance to the own centroid where ``known``
    known = np.zeros(len(points), bool)
    nearest_other = np.where(np.eye(len(centres), dtype=bool), np.inf, held.half).min(axis=1) if len(centres) > 1 else np.full(1, np.inf)
    open_ = np.flatnonzero(upper >= nearest_other[own])
    if len(open_):
        fresh_own = open_[fresh[open_]]  # the first centroid's distance is needed at any rate
        for c in range(len(centres)):
            some = open_[(own[open_] != c) & (upper[open_] >= lower[open_, c]) & (upper[open_] >= held.half[own[open_], c])]
            stale = some[~known[some]]
            for a in np.unique(own[stale]):
                rows = stale[own[stale] == a]
                exact[rows] = squares(points[rows], centres[a])
                lower[rows, a], upper[rows] = roots(exact[rows])
                known[rows] = True
                worked += len(rows)
            some = some[(upper[some] >= lower[some, c]) & (upper[some] >= held.half[own[some], c])]
            if not len(some):
                continue
            found = squares(points[some], centres[c])
            worked += len(some)
            low, high = roots(found)
            lower[some, c] = low
            better = (found < exact[some]) | ((found == exact[some]) & (c < own[some]))
            moved = some[better]
            own[moved], exact[moved], upper[moved] = c, found[better], high[better]
        rest = fresh_own[~known[fresh_own]]
        if len(rest):
            exact[rest] = squares(points[rest], centres[0])
            lower[rest, 0], upper[rest] = roots(exact[rest])
            worked += len(rest)
    return own, upper, lower, worked


def parts(value: int) -> Iterator[tuple[int, int]]:
    """(number, part) whose parts times 2 ** (PART * number) add up to ``value``."""
    sign, left, k = (-1 if value < 0 else 1), abs(value), 0
    while left:
        if low := left & ((1 << PART) - 1):
            yield k, sign * low
        left, k = left >> PART, k + 1


def one_round(state: DataFrame, held: Centroids) -> DataFrame:
    """``state`` after an assignment, and a row for each part of a change of a centroid's sum (dim 0 and up) or count (dim -1)."""
    shared = state.sparkSession.sparkContext.broadcast(held)  # a few centroids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, counts = shared.value, {}, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("vector")
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            points, centres = as_integers(vectors, known.centres)
            was = batch.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            lower = batch.column("lower").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own, upper, lower, _ = assign(points, centres, known, was, batch.column("upper").to_numpy(zero_copy_only=False), lower)
            changed = np.flatnonzero(own != was)
            for sign, label in ((1, own), (-1, was)):
                for c in np.unique(label[changed]).tolist():
                    rows = changed[label[changed] == c]
                    if c >= 0:
                        sums[c] = sums.get(c, 0) + sign * points[rows].sum(axis=0).astype(object)
                        counts[c] = counts.get(c, 0) + sign * len(rows)
            lines = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * len(centres), pa.int32()), pa.array(lower.ravel()))
            none = pa.nulls(len(own), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), column, pa.array(own, pa.int32()), pa.array(upper), lines, none, none, pa.nulls(len(own), pa.int64())], schema=KINDS)
        made = [(c, d, k, v) for c in sums for d, total in enumerate([counts[c], *sums[c]], -1) for k, v in parts(int(total))]
        if made:
            c, d, k, v = zip(*made)
            n = len(made)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, KINDS.field("vector").type), pa.array(c, pa.int32()), pa.nulls(n, pa.float64()), pa.nulls(n, KINDS.field("lower").type), pa.array(d, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.int64())], schema=KINDS)

    return state.select("vec_id", "vector", "cluster", "upper", "lower").mapInArrow(work, STATE)


def changes(written: DataFrame) -> dict[tuple[int, int], int]:
    """Change of each centroid's count (dim -1) and sums: as many rows as there are components, times the parts of a number."""
    rows = written.where(F.col("dim").isNotNull()).groupBy("cluster", "dim", "part").agg(F.sum("value").alias("value")).collect()
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r.cluster, r.dim] = out.get((r.cluster, r.dim), 0) + (r.value << (PART * r.part))
    return out


def with_distances(state: DataFrame, centres: list[list[int]]) -> DataFrame:
    """vec_id, cluster and the exact squared distance to its centroid; one beyond a long counts as the largest."""
    shared = state.sparkSession.sparkContext.broadcast(centres)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            points, exact = as_integers(vectors, shared.value)
            found = ((points - exact[batch.column("cluster").to_numpy(zero_copy_only=False)]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array([min(int(x), LARGEST) for x in found], pa.int64())], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "vector", "cluster").mapInArrow(work, "vec_id long, cluster int, distance long")


def fit_centroids(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, vector, cluster, bounds) after the last assignment, stored, and the centroids (integers).

    Fewer vectors than ``count`` give as many centroids; none give none.
    """
    kept = kept_vectors(vectors, dimensions)
    centres = first_centroids(kept, count, seed)
    state = kept.select("vec_id", "vector", F.lit(-1).alias("cluster"), F.lit(0.0).alias("upper"), F.array_repeat(F.lit(0.0), len(centres)).alias("lower"))
    if not centres:
        return state, centres
    store, totals, before = Stored(vectors.sparkSession), {}, None
    for done in range(rounds + 1):
        written = store.keep(one_round(state, Centroids(centres, before)), "state")
        state = written.where(F.col("dim").isNull())
        if done < rounds:
            for key, value in changes(written).items():
                totals[key] = totals.get(key, 0) + value
            before = centres
            # Python's // is the exact floor
            centres = [[totals.get((c, d), 0) // n for d in range(dimensions)] if (n := totals.get((c, -1), 0)) else centre for c, centre in enumerate(centres)]
    return state, centres


def cluster_vectors(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part (``kept_vectors``).

    A vector that is null, of another length, or has a null or non-finite component (or one that is none
    when scaled) is left out. Repeated rows are vectors each for itself; a null vec_id is kept and comes last in the
    choice of centroids. Of equal distances the smaller cluster wins. Distances and their sums beyond a long
    count as the largest long. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    state, centres = fit_centroids(vectors, count, rounds, dimensions, seed)
    near = with_distances(state, centres)
    totals = {r.cluster: int(r.total) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}  # a row a centroid
    every = min(sum(totals.values()), LARGEST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    known = [(c, min(totals.get(c, 0), LARGEST), every, digest) for c, digest in enumerate(digests)]
    table = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def cluster_sql(rounds: int = ROUNDS) -> str:
    """The same in SQL, a step a round; for tables whose rows differ in vec_id."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), x AS MATERIALIZED (
  SELECT vec_id, unnest(range(64)) AS i, unnest(e) AS x FROM v
), c0 AS MATERIALIZED (
  SELECT c, i, x FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM v) JOIN x USING (vec_id) WHERE c < 8
)"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (
  SELECT vec_id, min(struct_pack(d := d, c := c)) AS best
  FROM (SELECT x.vec_id, k.c, sum((x.x - k.x) * (x.x - k.x))::BIGINT AS d FROM x JOIN c{r} k ON x.i = k.i GROUP BY x.vec_id, k.c) GROUP BY vec_id
)"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT k.c, k.i, coalesce(n.x, k.x) AS x
  FROM c{r} k LEFT JOIN (
    SELECT c, i, (s - ((s % n) + n) % n) // n AS x
    FROM (SELECT a.best.c AS c, x.i, sum(x.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN x USING (vec_id) GROUP BY 1, 2)
  ) n ON k.c = n.c AND k.i = n.i
)"""
            )
    return f"""
WITH {", ".join(steps)}, digests AS (
  SELECT c, sha256(string_agg(x::BIGINT::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c
)
SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d AS distance, sum(a.best.d) OVER (PARTITION BY a.best.c)::BIGINT AS cluster_inertia,
       sum(a.best.d) OVER ()::BIGINT AS inertia, g.centroid_sha256
FROM a{rounds} a JOIN digests g ON a.best.c = g.c
"""
