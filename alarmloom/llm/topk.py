"""Exact top-k inner products with a pivot table.

For a query q and a candidate c, |d(q, p) - d(c, p)| is at most d(q, c) for every
pivot p, and the inner product is (|q|^2 + |c|^2 - d(q, c)^2) / 2. So precomputed
distances to the pivots bound it from above. Each query first meets a bounded
sample of the candidates; its k-th best score there is a floor that goes with
it to every block. In each block candidates are worked
out in the order of their bounds until the floor or the k-th best score is above every bound
that is left; what is left cannot be in the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

PIVOTS, PIVOT_SAMPLE = 32, 256
QUERY_BLOCK, BLOCKS, LEAST_BLOCK, MOST_BLOCK = 4096, 64, 512, 32_768
FIRST, SEEDS = 64, 4096
SCALE = 256.0


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding and its length of the rows that take part: an id, no null and only components that are finite, 256 times too."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double") * SCALE) < float("inf")) & ~F.isnan(x))
    kept = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("dim"))


def integers(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """floor(256 * x) of all components, a row a vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), dim)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Of each point to each pivot; not a number where squares are beyond doubles, which rules nothing out."""
    with np.errstate(over="ignore", invalid="ignore"):
        squares = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
        return np.sqrt(np.maximum(squares, 0))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Each pivot is the sampled vector furthest from those before it."""
    chosen = [0] if len(sample) else []
    while chosen and len(chosen) < min(count, len(sample)):
        least = distances(sample, sample[chosen]).min(axis=1)
        if least.max() <= 0:
            break
        chosen.append(int(least.argmax()))
    return sample[chosen]


def pivots_of(vectors: DataFrame, count: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots for each vector length, from the PIVOT_SAMPLE first vectors by hash."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "embedding")).limit(PIVOT_SAMPLE).collect()
    by_dim: dict[int, list] = {}
    for r in rows:
        by_dim.setdefault(r.dim, []).append(r.embedding)
    return {dim: choose_pivots(np.floor(SCALE * np.array(x, dtype=float).reshape(len(x), dim)), count) for dim, x in by_dim.items()}


def with_pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``vectors`` with the distances of each to the pivots of its length."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors a length

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            table: list = [None] * batch.num_rows
            for dim in np.unique(dims).tolist():
                rows = np.flatnonzero(dims == dim)
                points = integers(batch.column("embedding").take(pa.array(rows)), dim)
                own = shared.value.get(dim, np.zeros((0, dim)))
                for row, line in zip(rows.tolist(), distances(points, own)):
                    table[row] = line
            columns = [*batch.columns, pa.array(table, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "to_pivots"])

    return vectors.mapInArrow(work, "vec_id long, embedding array<double>, dim int, to_pivots array<double>")


def exact_scores(candidates: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; exact in doubles as long as they stay under 2 ** 53, else in Python's integers.

    Scores beyond a long count as the largest or least long.
    """
    largest = np.abs(candidates).max(initial=0) * np.abs(query).max(initial=0) * max(1, len(query))
    if largest < 2**53:
        return (candidates @ query).astype(np.int64)
    return np.array([min(max(sum(int(a) * int(b) for a, b in zip(row, query)), -(1 << 63)), (1 << 63) - 1) for row in candidates], dtype=np.int64)


def block_top(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, points: np.ndarray, table: np.ndarray, query_table: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[int, int, int]]:
    """(query's row, candidate's row, score) of each query's k best of a block, its own id left out; none below its floor."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        norms, query_norms = (points**2).sum(1), (queries**2).sum(1)
        for start in range(0, len(queries), 64):
            part = slice(start, start + 64)
            low = np.zeros((len(queries[part]), len(points)), np.float32)
            for p in range(table.shape[1]):
                np.maximum(low, np.abs(query_table[part, p, None].astype(np.float32) - table[None, :, p].astype(np.float32)), out=low)
            total = query_norms[part, None] + norms[None, :]
            # the slack covers rounding, so that no bound is too low; a bound beyond doubles rules nothing out
            bounds = np.nan_to_num((total - low.astype(np.float64) ** 2) / 2 + 1 + 1e-5 * total, nan=np.inf, posinf=np.inf, neginf=np.inf)
            for row, bound in enumerate(bounds):
                q = start + row
                out += [(q, i, s) for i, s in query_top(query_ids[q], queries[q], ids, points, bound, k, int(floors[q]))]
    return out


def query_top(query_id: int, query: np.ndarray, ids: np.ndarray, points: np.ndarray, bound: np.ndarray, k: int, floor: int) -> list[tuple[int, int]]:
    open_ = np.flatnonzero((bound >= floor) & (ids != query_id))
    order = open_[np.argsort(-bound[open_], kind="stable")]
    best: list[tuple[int, int, int]] = []  # (-score, id, row)
    at, size = 0, max(FIRST, 4 * k)
    while at < len(order) and (len(best) < k or bound[order[at]] >= -best[-1][0]):
        rows = order[at : at + size]
        scores = exact_scores(points[rows], query)
        least = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k])) if len(rows) > 4 * k else floor
        some = scores >= least
        best = sorted(best + [(-int(s), int(ids[r]), int(r)) for s, r in zip(scores[some], rows[some])])[:k]
        at, size = at + size, 2 * size
    return [(row, -score) for score, _, row in best]


LEAST_LONG = -(1 << 63)


def exact_top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, pivots: int = PIVOTS, blocks: tuple[int, int] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best candidates of each query.

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates
    are all rows with another vec_id. Ties go to the smaller vec_id. Rows that do not take part (see
    ``usable``) are left out; vectors of unlike lengths have no inner product and
    are not compared. Repeated rows are candidates each for itself, and a repeated
    query counts once. An empty table gives no rows; other columns are not looked at.
    Blocks of queries meet blocks of candidates, both by hash;
    each pair of blocks gives k rows a query at most, and those are ranked. ``blocks``: the numbers of
    query and candidate blocks, by default from the number of rows.
    """
    base = usable(vectors)
    n = base.count()
    block = min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))
    query_blocks, candidate_blocks = blocks or (max(1, -(-n // (query_every * QUERY_BLOCK))), max(1, -(-n // block)))
    table = with_pivot_table(base, pivots_of(base, pivots)).withColumn("row", F.xxhash64("vec_id", "embedding"))

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def cell(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list = []
        if asked.num_rows and held.num_rows:
            dim = asked.column("dim")[0].as_py()
            query_ids, ids = asked.column("vec_id").to_numpy(), held.column("vec_id").to_numpy()
            tables = [np.array(t.column("to_pivots").to_pylist(), float).reshape(t.num_rows, -1) for t in (held, asked)]
            found = block_top(query_ids, integers(asked.column("embedding"), dim), ids, integers(held.column("embedding"), dim), *tables, k, asked.column("floor").to_numpy())
            rows = asked.column("row").to_numpy()
            out = [(int(query_ids[q]), int(rows[q]), int(ids[i]), s) for q, i, s in found]
        kinds = ("query_id", "query_row", "vec_id", "score")
        return pa.table({name: pa.array([r[i] for r in out], pa.int64()) for i, name in enumerate(kinds)})

    def met(asked: DataFrame, held: DataFrame, *cells: str) -> DataFrame:
        return asked.groupBy(*cells).cogroup(held.groupBy(*cells)).applyInArrow(cell, "query_id long, query_row long, vec_id long, score long")

    def renamed(df: DataFrame) -> DataFrame:
        """The same columns as new ones: both sides of a pairing come from one table."""
        return df.select(*(F.col(c).alias(c) for c in df.columns))

    queries = table.where(F.col("vec_id") % query_every == 0).dropDuplicates(["vec_id", "row"])
    queries = queries.withColumn("query_block", F.pmod("row", F.lit(query_blocks)).cast("int")).withColumn("floor", F.lit(LEAST_LONG))
    # about SEEDS candidates in all, for each block of queries
    seeds = table.where(F.pmod(F.xxhash64("row"), F.lit(max(1, n // SEEDS))) == 0).withColumn("query_block", numbers(query_blocks))
    first = checkpointed(met(queries, renamed(seeds), "dim", "query_block").groupBy("query_id", "query_row").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("seed")))
    own = (F.col("vec_id") == F.col("query_id")) & (F.col("row") == F.col("query_row"))
    left = queries.drop("floor").join(first.where(F.col("found") >= k), own, "left").withColumn("floor", F.coalesce("seed", F.lit(LEAST_LONG))).drop("query_id", "query_row", "found", "seed")
    left = left.withColumn("block", numbers(candidate_blocks))
    right = table.withColumn("block", F.pmod("row", F.lit(candidate_blocks)).cast("int")).withColumn("query_block", numbers(query_blocks))
    found = met(renamed(left), renamed(right), "dim", "query_block", "block")
    place = F.row_number().over(Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""
