"""Similar earlier episodes: time gates, exact cosine top-k, outcome Jaccard, ranking measures.

Best candidates come from an inverted index in blocks of time (``best_candidates``), the sizes of pools from running
counts, and the relevant candidates of a pool from products of blocks of sets of codes (``relevant_counts``); none of
these makes a row for each pair. Similarities are rounded to twelve digits before they are ranked,
so that the order does not hang on the order of summation.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, micros, ratio
from ..functions.storage import stored

POLICIES = ("expanding_history", "train_only")
STATUSES = ("query_outcome_incomplete", "query_without_future_alarms", "no_evaluable_candidates", "evaluated")
#: Rows of a block, and ranges of time.
QUERY_BLOCK, CANDIDATE_BLOCK, MOST_RANGES = 16_384, 4_096, 1_024
#: Candidates of a block whose outcomes are compared; queries, candidates and codes of a tile of it.
HELD_BLOCK, QUERY_TILE, HELD_TILE, CODE_TILE = 32_768, 1_024, 2_048, 512
DIGITS, SLACK = 12, 1e-9


def checked_policy(policy: str) -> str:
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {', '.join(POLICIES)}")
    return policy


def history_gate(q: str = "q", c: str = "c", policy: str = "expanding_history") -> Column:
    """The candidate ended before the query began and is another episode."""
    gate = (F.col(f"{c}.end_time") < F.col(f"{q}.start_time")) & (F.col(f"{c}.incident_id") != F.col(f"{q}.incident_id"))
    return gate if checked_policy(policy) == "expanding_history" else gate & (F.col(f"{c}.split") == "train")


def historical_candidates(episodes: DataFrame, incident_id: str, policy: str = "expanding_history") -> DataFrame:
    """Candidates of one episode; an unknown id raises KeyError."""
    query = episodes.where(F.col("incident_id") == incident_id).limit(2).collect()
    if len(query) != 1:
        raise KeyError(f"unknown incident_id: {incident_id}")
    kept = episodes.where((F.col("end_time") < F.lit(query[0].start_time)) & (F.col("incident_id") != incident_id))
    return kept if checked_policy(policy) == "expanding_history" else kept.where(F.col("split") == "train")


def evaluable_candidates(episodes: DataFrame, outcomes: DataFrame, incident_id: str, policy: str = "expanding_history") -> DataFrame:
    """Those whose outcome was complete and over before the query began."""
    start = episodes.where(F.col("incident_id") == incident_id).first()
    if start is None:
        raise KeyError(f"unknown incident_id: {incident_id}")
    over = outcomes.where(F.col("outcome_is_complete") & (F.col("outcome_end_time") < F.lit(start.start_time))).select("incident_id")
    return historical_candidates(episodes, incident_id, policy).join(over, "incident_id", "left_semi")


DAY = 86_400_000_000


def counts_before(asked: DataFrame, readies: DataFrame, *keys: str) -> DataFrame:
    """incident_id of each row of ``asked`` (keys, incident_id, us) with the sums, over rows of ``readies`` (keys, us and numbers) that come strictly before it.

    Running sums over both together, so no pairs are made. Moments are dealt out by day: totals of days
    first, then inside each day.
    """
    values = [c for c in readies.columns if c not in (*keys, "us")]
    zeros = asked.select(*keys, "incident_id", "us", *(F.lit(0).cast("long").alias(v) for v in values), F.lit(0).alias("late"))
    # at one moment those who ask come first: what is ready counts only if it is ready strictly before
    adds = readies.select(*keys, F.lit(None).cast("string").alias("incident_id"), "us", *(F.col(v).cast("long").alias(v) for v in values), F.lit(1).alias("late"))
    moments = zeros.unionByName(adds).withColumn("day", F.floor(F.col("us") / DAY))
    totals = moments.groupBy(*keys, "day").agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "day", *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"base_{v}") for v in values))
    running = Window.partitionBy(*keys, "day").orderBy("us", "late").rowsBetween(Window.unboundedPreceding, 0)
    inside = moments.withColumns({v: F.sum(v).over(running) for v in values}).where(F.col("incident_id").isNotNull())
    return inside.join(before, [*keys, "day"]).select("incident_id", *((F.col(v) + F.col(f"base_{v}")).alias(v) for v in values))


def pool_sizes(episodes: DataFrame, ready: Column, policy: str = "expanding_history") -> DataFrame:
    """(incident_id, pool): for each episode the number of candidates that are ``ready`` (a time column, null: never) before it starts."""
    counts = ready if policy == "expanding_history" else F.when(F.col("split") == "train", ready)
    readies = episodes.select(micros(counts).alias("us"), F.lit(1).alias("pool")).where(F.col("us").isNotNull())
    return counts_before(episodes.select("incident_id", micros("start_time").alias("us")), readies)


@dataclass(frozen=True)
class Search:
    """What a search ranks and counts."""

    k: int = 5
    policy: str = "expanding_history"
    outcome_gate: bool = True
    thresholds: tuple[float, ...] = (0.3,)

    def __post_init__(self):
        if self.k <= 0:
            raise ValueError("k must be above zero")
        checked_policy(self.policy)
        if not all(0 < t <= 1 for t in self.thresholds):
            raise ValueError("thresholds must be above 0 and at most 1")


BEST = "array<struct<similarity:double,end_us:bigint,candidate_id:string,jaccard:double>>"


def searchable(episodes: DataFrame, vectors: DataFrame, outcomes: DataFrame | None, queries: DataFrame, search: Search) -> DataFrame:
    """One row an episode with all that a search needs; ``moment``: from when it may be found (null: never); ``asked``: whether it is a query."""
    base = episodes.select("incident_id", "split", micros("start_time").alias("start_us"), micros("end_time").alias("end_us")).join(vectors.select("incident_id", "terms", "shape"), "incident_id")
    if outcomes is None:
        base = base.withColumns({"ready_us": F.col("end_us"), "codes": F.array().cast("array<string>")})
    else:
        ready = F.when(F.col("outcome_is_complete"), micros("outcome_end_time"))
        base = base.join(outcomes.select("incident_id", ready.alias("ready_us"), F.col("future_alarm_codes").alias("codes")), "incident_id")
    moment = F.when(F.col("ready_us").isNotNull(), F.greatest("end_us", "ready_us")) if search.outcome_gate else F.col("end_us")
    if search.policy == "train_only":
        moment = F.when(F.col("split") == "train", moment)
    flags = queries.select("incident_id", F.lit(True).alias("asked")).distinct()
    return base.join(flags, "incident_id", "left").select("incident_id", "start_us", "end_us", moment.alias("moment"), "terms", "shape", "codes", F.coalesce("asked", F.lit(False)).alias("asked"))


class PostingBlock:
    """An inverted index of a block of candidates in the order of their moments: by token, its rows, weights and largest weight."""

    def __init__(self, held: pa.Table):
        order = np.argsort(held.column("moment").to_numpy(), kind="stable")
        held = held.take(pa.array(order)).combine_chunks()
        self.moments, self.ends = held.column("moment").to_numpy(), held.column("end_us").to_numpy()
        self.ids, self.codes = held.column("incident_id").to_pylist(), held.column("codes")
        self.shapes = held.column("shape").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        terms = held.column("terms").combine_chunks()
        self.starts = np.concatenate([[0], np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))]).astype(np.int64)
        entries = terms.flatten()
        tokens = pc.dictionary_encode(entries.field("token"))
        self.token_of, self.weight = tokens.indices.to_numpy(zero_copy_only=False), entries.field("weight").to_numpy(zero_copy_only=False)
        self.numbers = {t: i for i, t in enumerate(tokens.dictionary.to_pylist())}
        row = np.repeat(np.arange(held.num_rows), np.diff(self.starts))
        by_token = np.argsort(self.token_of, kind="stable")
        self.rows = row[by_token]
        self.limits = np.searchsorted(self.token_of[by_token], np.arange(len(self.numbers) + 1))
        self.most = np.array([np.abs(self.weight[by_token][a:b]).max() for a, b in zip(self.limits[:-1], self.limits[1:])])
        self.longest = np.sqrt((self.shapes**2).sum(1)).max(initial=0.0)

    def scores(self, rows: np.ndarray, query: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Similarity of ``rows`` to a query (a weight for each token of the block), from their own terms alone."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        sums = np.bincount(np.repeat(np.arange(len(rows)), sizes), self.weight[at] * query[self.token_of[at]], minlength=len(rows))
        return np.round(sums + self.shapes[rows] @ shape, DIGITS) + 0.0

    def best(self, incident_id: str, start_us: int, terms: list[dict], shape: np.ndarray, floor: float, k: int) -> tuple[list[tuple[float, int]], int]:
        """The ``k`` best (similarity, row) of those found before ``start_us`` with a similarity of ``floor`` or more, and how many were worked out.

        Tokens are taken in the order of the most they can add; the best of those that have the first one raise the floor. When what those that are left can add, with the shape, is below
        the floor, rows that have none of the tokens so far cannot reach it.
        """
        limit = int(np.searchsorted(self.moments, start_us, "left"))
        query = np.zeros(len(self.numbers))
        known = [(abs(t["weight"]) * self.most[n], n) for t in terms if (n := self.numbers.get(t["token"])) is not None]
        for t in terms:
            if (n := self.numbers.get(t["token"])) is not None:
                query[n] = t["weight"]
        known.sort(reverse=True)
        left = sum(b for b, _ in known) + float(np.sqrt((shape**2).sum())) * self.longest + SLACK
        if left < floor or not limit:
            return [], 0
        if known:  # rows of the token that can add most raise the floor
            first = self.rows[self.limits[known[0][1]] : self.limits[known[0][1] + 1]]
            first = first[first < limit]
            if len(first) > k:  # one more: the query itself may be among them
                found = self.scores(first, query, shape)
                floor = max(floor, float(np.partition(found, len(found) - k - 1)[len(found) - k - 1]))
        lists = []
        for bound, n in known:
            if left < floor:
                break
            lists.append(self.rows[self.limits[n] : self.limits[n + 1]])
            left -= bound
        if left < floor:
            rows = np.unique(np.concatenate(lists))
            rows = rows[rows < limit]
        else:
            rows = np.arange(limit)
        similar = self.scores(rows, query, shape)
        if len(rows) > 4 * k:
            some = similar >= max(floor, np.partition(similar, len(similar) - k - 1)[len(similar) - k - 1])  # one more: the query itself may be among them
            rows, similar, worked = rows[some], similar[some], len(rows)
        else:
            worked = len(rows)
        order = sorted(((-s, -self.ends[r], self.ids[r], r) for s, r in zip(similar.tolist(), rows.tolist()) if self.ids[r] != incident_id))[:k]
        return [(-s, r) for s, _, _, r in order], worked


def overlap(a: list[str], b: list[str]) -> float:
    both = len(set(a) & set(b))
    return both / (len(set(a)) + len(set(b)) - both) if both else 0.0


def block_result(asked: pa.Table, held: pa.Table, k: int) -> pa.Table:
    out: list[tuple] = []
    if asked.num_rows and held.num_rows:
        block = PostingBlock(held)
        columns = zip(*(asked.column(c).to_pylist() for c in ("incident_id", "start_us", "terms", "shape", "codes", "floor")))
        for incident_id, start_us, terms, shape, codes, floor in columns:
            best, worked = block.best(incident_id, start_us, terms, np.array(shape), floor, k)
            if best or worked:
                rows = [{"similarity": s, "end_us": int(block.ends[r]), "candidate_id": block.ids[r], "jaccard": overlap(codes, block.codes[r].as_py())} for s, r in best]
                out.append((incident_id, rows, worked))
    kind = pa.list_(pa.struct([("similarity", pa.float64()), ("end_us", pa.int64()), ("candidate_id", pa.string()), ("jaccard", pa.float64())]))
    return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate((("incident_id", pa.string()), ("best", kind), ("worked", pa.int64())))})


def best_order(a: Column, b: Column) -> Column:
    return (
        F.when(a["similarity"] != b["similarity"], F.when(a["similarity"] > b["similarity"], -1).otherwise(1))
        .when(a["end_us"] != b["end_us"], F.when(a["end_us"] > b["end_us"], -1).otherwise(1))
        .otherwise(F.when(a["candidate_id"] < b["candidate_id"], -1).when(a["candidate_id"] > b["candidate_id"], 1).otherwise(0))
    )


def merged(parts: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best")), best_order), 1, k)
    return parts.groupBy("incident_id").agg(best.alias("best"), F.sum("worked").alias("worked"))


def best_candidates(rows: DataFrame, search: Search) -> DataFrame:
    """(incident_id, best, worked) of each query of ``rows`` (stored) that has candidates; worked: the candidates whose similarity was worked out.

    Candidates lie in blocks, ranges of their moments. A query first meets the block before its own time; its k-th best there
    is a floor that goes with it to the blocks before and its own one. A candidate is sent once for QUERY_BLOCK queries, and no block
    holds a row for each pair of row and token.
    """
    shares = [i / MOST_RANGES for i in range(1, MOST_RANGES)]
    asked_count, n, quantiles = rows.agg(F.count_if("asked"), F.count("moment"), F.percentile_approx("moment", shares, 10_000)).first()
    wanted = min(MOST_RANGES, ceil(n / CANDIDATE_BLOCK))
    # a moment that many quantiles fall on is a range of several blocks
    counts = Counter(quantiles[ceil(i * MOST_RANGES / wanted) - 1] for i in range(1, wanted)) if wanted > 1 else Counter()
    cuts = sorted(counts)
    parts = [max(1, ceil(n / MOST_RANGES / CANDIDATE_BLOCK))] + [max(counts[c], ceil(n / MOST_RANGES / CANDIDATE_BLOCK)) for c in cuts]
    query_blocks = max(1, ceil(asked_count / QUERY_BLOCK))
    limits = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.array().cast("array<bigint>")
    pieces = F.array(*map(F.lit, parts))

    def spread(count: Column) -> Column:
        return F.sequence(F.lit(0), count.cast("int") - 1)

    held = rows.where(F.col("moment").isNotNull()).withColumn("range", F.size(F.filter(limits, lambda c: c <= F.col("moment"))))
    held = held.withColumn("part", F.pmod(F.xxhash64("incident_id"), F.element_at(pieces, F.col("range") + 1)).cast("int")).select("incident_id", "end_us", "moment", "terms", "shape", "codes", "range", "part", F.explode(spread(F.lit(query_blocks))).alias("qb"))
    queries = rows.where("asked").select("incident_id", "start_us", "terms", "shape", "codes", F.size(F.filter(limits, lambda c: c < F.col("start_us"))).alias("last"), F.pmod(F.xxhash64("incident_id"), F.lit(query_blocks)).cast("int").alias("qb"))
    queries = queries.withColumn("seed", F.greatest(F.col("last") - 1, F.lit(0)))
    k, keys = search.k, ("range", "part", "qb")

    def block(q: pa.Table, c: pa.Table) -> pa.Table:
        return block_result(q, c, k)

    def met(asked: DataFrame) -> DataFrame:
        other = held.select(*(F.col(c).alias(c) for c in held.columns))  # both sides come from the same rows; new names keep them apart
        return asked.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInArrow(block, f"incident_id string, best {BEST}, worked long")

    own = queries.withColumn("floor", F.lit(float("-inf"))).withColumn("range", F.col("seed"))
    first = met(own.withColumn("part", F.explode(spread(F.element_at(pieces, F.col("range") + 1)))))
    if not cuts:
        return merged(first, k)
    found = stored(merged(first, k))
    floors = found.select(F.col("incident_id").alias("of"), F.when(F.size("best") >= k, F.element_at("best", k)["similarity"]).alias("seen"))
    rest = queries.join(floors, F.col("incident_id") == F.col("of"), "left").withColumn("floor", F.coalesce("seen", F.lit(float("-inf")))).drop("of", "seen")
    rest = rest.withColumn("range", F.explode(F.sequence(F.lit(0), F.col("last")))).where("range <> seed")
    more = met(rest.withColumn("part", F.explode(spread(F.element_at(pieces, F.col("range") + 1)))))
    return merged(found.unionByName(more), k)


def entries_of(codes: pa.ChunkedArray, numbers: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (row, number of the code) of rows of codes, by row, and how many each row has; ``numbers`` takes in new codes."""
    held = codes.combine_chunks()
    held = held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held
    words = pc.dictionary_encode(held.flatten(), null_encoding="encode")
    known = np.array([numbers.setdefault(w, len(numbers)) for w in words.dictionary.to_pylist()], dtype=np.int64)
    lengths = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False)
    row, code = np.repeat(np.arange(len(held)), lengths), known[words.indices.to_numpy(zero_copy_only=False)]
    pairs = np.unique(row * max(1, len(numbers)) + code)
    row, code = np.divmod(pairs, max(1, len(numbers)))
    return row, code, np.bincount(row, minlength=len(held))


def tiles(row: np.ndarray, code: np.ndarray, start: int, stop: int, width: int) -> list[np.ndarray]:
    """Rows ``start`` to ``stop`` as matrices of zeros and ones, a matrix for each CODE_TILE codes of ``width``."""
    some = slice(*np.searchsorted(row, [start, stop]))
    out = []
    for low in range(0, width, CODE_TILE):
        here = (code[some] >= low) & (code[some] < low + CODE_TILE)
        tile = np.zeros((stop - start, min(CODE_TILE, width - low)), dtype=np.float32)
        tile[row[some][here] - start, code[some][here] - low] = 1
        out.append(tile)
    return out


def least_shared(most: int, threshold: float) -> np.ndarray:
    """For two sets by the sum of their sizes, up to ``most``: the fewest codes in common with which their Jaccard similarity is ``threshold``."""
    least = np.full(most + 1, np.inf, dtype=np.float32)
    for total in range(2, most + 1):
        n = max(1, int(threshold * total / (1 + threshold)) - 1)
        while n / (total - n) < threshold:
            n += 1
        least[total] = n
    return least


def relevant_in_block(asked: pa.Table, held: pa.Table, thresholds: tuple[float, ...]) -> pa.Table:
    """incident_id of each of ``asked`` with the numbers of ``held`` before it that reach each threshold; sizes of sets in common are products of matrices of zeros and ones."""
    counts = np.zeros((len(thresholds), asked.num_rows), dtype=np.int64)
    if asked.num_rows and held.num_rows:
        held = held.take(pa.array(np.argsort(held.column("moment").to_numpy(), kind="stable")))
        numbers: dict = {}
        held_row, held_code, held_size = entries_of(held.column("codes"), numbers)
        shared = len(numbers)  # codes of queries alone are in no intersection
        row, code, size = entries_of(asked.column("codes"), numbers)
        own = code < shared
        row, code = row[own], code[own]
        moments, starts = held.column("moment").to_numpy(), asked.column("start_us").to_numpy()
        least = [least_shared(int(size.max() + held_size.max()), t) for t in thresholds]
        queries = [(a, min(a + QUERY_TILE, asked.num_rows)) for a in range(0, asked.num_rows, QUERY_TILE)]
        for c in range(0, held.num_rows, HELD_TILE):
            d = min(c + HELD_TILE, held.num_rows)
            candidates = tiles(held_row, held_code, c, d, shared)
            for a, b in queries:
                limits = np.searchsorted(moments[c:d], starts[a:b], "left")
                if not limits.any():
                    continue
                both = np.zeros((b - a, d - c), dtype=np.float32)
                for q, x in zip(tiles(row, code, a, b, shared), candidates):
                    both += q @ x.T
                for i in np.flatnonzero(limits < d - c):
                    both[i, limits[i] :] = -1
                for n in np.unique(size[a:b]):  # queries of one size need the same of a candidate
                    of_size = np.flatnonzero(size[a:b] == n)
                    part = both[of_size]
                    for i, table in enumerate(least):
                        counts[i, a + of_size] += np.count_nonzero(part >= table[n + held_size[c:d]], axis=1)
    return pa.table({"incident_id": asked.column("incident_id").cast(pa.string()), **{f"r{i}": pa.array(x) for i, x in enumerate(counts)}})


def relevant_counts(rows: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """incident_id of each query of ``rows`` (stored) with r0, r1, ...: the candidates before it whose codes have at least that Jaccard similarity with its own.

    All pairs, as low thresholds leave most of them: queries and candidates are dealt into blocks, each two of which are a task that holds
    tiles of QUERY_TILE by HELD_TILE numbers and gives a row a query; no row is made for a pair.
    """
    asked_count, n, last = rows.agg(F.count_if("asked"), F.count("moment"), F.max(F.when(F.col("asked"), F.col("start_us")))).first()
    # small tables are cut finer, to be several tasks
    query_blocks = max(1, ceil(asked_count / QUERY_BLOCK), min(4, asked_count // QUERY_TILE))
    held_blocks = max(1, ceil(n / HELD_BLOCK), min(8, n // HELD_TILE))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        placed = df.withColumn(own, F.pmod(F.xxhash64("incident_id"), F.lit(blocks)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    asked = dealt(rows.where("asked").select("incident_id", "start_us", "codes"), "qb", query_blocks, "hb", held_blocks)
    held = rows.where(F.col("moment") < F.lit(last)).select(*(F.col(c).alias(c) for c in ("incident_id", "moment", "codes")))
    held = dealt(held, "hb", held_blocks, "qb", query_blocks)
    names = [f"r{i}" for i in range(len(thresholds))]

    def block(q: pa.Table, c: pa.Table) -> pa.Table:
        return relevant_in_block(q, c, thresholds)

    parts = asked.groupBy("qb", "hb").cogroup(held.groupBy("qb", "hb")).applyInArrow(block, ", ".join(["incident_id string", *(f"{r} long" for r in names)]))
    return parts.groupBy("incident_id").agg(*(F.sum(r).alias(r) for r in names))


def counted(rows: DataFrame, search: Search) -> DataFrame:
    """(incident_id, pool, relevant) of each query of ``rows`` that has candidates; relevant: a number for each threshold."""
    pools = counts_before(rows.where("asked").select("incident_id", F.col("start_us").alias("us")), rows.where(F.col("moment").isNotNull()).select(F.col("moment").alias("us"), F.lit(1).alias("pool"))).where("pool > 0")
    if not search.thresholds:
        return pools.withColumn("relevant", F.array().cast("array<bigint>"))
    names = [f"r{i}" for i in range(len(search.thresholds))]
    return pools.join(relevant_counts(rows, search.thresholds), "incident_id").select("incident_id", "pool", F.array(*names).alias("relevant"))


def top_candidates(episodes: DataFrame, vectors: DataFrame, outcomes: DataFrame | None, queries: DataFrame, search: Search) -> DataFrame:
    """(incident_id, best) for each of ``queries`` that has candidates; nothing is counted."""
    return best_candidates(stored(searchable(episodes, vectors, outcomes, queries, search)), search).drop("worked")


def retrieve(episodes: DataFrame, vectors: DataFrame, outcomes: DataFrame | None, queries: DataFrame, search: Search) -> DataFrame:
    """(incident_id, pool, relevant, best) for each of ``queries`` (incident_id) that has candidates.

    ``best``: up to k candidates by similarity, then later end, then id; ``relevant``: for each
    threshold the candidates of the whole pool whose outcome is at least so similar.
    """
    rows = stored(searchable(episodes, vectors, outcomes, queries, search))
    return counted(rows, search).join(best_candidates(rows, search).drop("worked"), "incident_id")


def ranked_results(found: DataFrame, episodes: DataFrame, raw_codes: DataFrame, feature_version: str, policy: str) -> DataFrame:
    """Eleven columns of a result list; shared codes are those of both documents as written."""
    flat = found.select(F.col("incident_id").alias("query_incident_id"), F.posexplode("best").alias("pos", "b"))
    rows = flat.select("query_incident_id", (F.col("pos") + 1).alias("rank"), F.col("b.candidate_id").alias("candidate_incident_id"), F.col("b.similarity").alias("similarity_score"), F.col("b.jaccard").alias("outcome_jaccard"))
    about = episodes.join(raw_codes, "incident_id").select("incident_id", "machine_id", "start_time", "end_time", "codes")
    q = about.select(F.col("incident_id").alias("query_incident_id"), F.col("machine_id").alias("__qm"), F.col("codes").alias("__qc"))
    c = about.select(F.col("incident_id").alias("candidate_incident_id"), F.col("machine_id").alias("candidate_machine_id"), F.col("start_time").alias("candidate_start_time"), F.col("end_time").alias("candidate_end_time"), F.col("codes").alias("__cc"))
    joined = rows.join(q, "query_incident_id").join(c, "candidate_incident_id")
    return joined.select(
        "query_incident_id", "rank", "candidate_incident_id", "similarity_score", F.lit(feature_version).alias("feature_version"), F.lit(policy).alias("candidate_policy"),
        "candidate_machine_id", "candidate_start_time", "candidate_end_time", (F.col("__qm") == F.col("candidate_machine_id")).alias("same_machine"),
        F.array_sort(F.array_intersect("__qc", "__cc")).alias("shared_alarm_codes"),
    )


def raw_codes(documents: DataFrame) -> DataFrame:
    return documents.select("incident_id", F.array_distinct(F.split("alarm_document", " ")).alias("codes"))


def label_relevance(results: DataFrame, episodes: DataFrame, outcomes: DataFrame, threshold: float) -> DataFrame:
    """Adds eight columns; a pair that is not eligible has no Jaccard and no label."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    q = outcomes.select(F.col("incident_id").alias("query_incident_id"), F.col("outcome_is_complete").alias("query_outcome_is_complete"), F.col("has_future_alarms").alias("query_has_future_alarms"), F.col("future_alarm_codes").alias("__qc"))
    q = q.join(episodes.select(F.col("incident_id").alias("query_incident_id"), F.col("start_time").alias("__start")), "query_incident_id")
    c = outcomes.select(F.col("incident_id").alias("candidate_incident_id"), F.col("outcome_is_complete").alias("candidate_outcome_is_complete"), F.col("outcome_end_time").alias("__end"), F.col("future_alarm_codes").alias("__cc"))
    joined = results.join(q, "query_incident_id").join(c, "candidate_incident_id")
    available = F.col("__end") < F.col("__start")
    eligible = F.col("query_outcome_is_complete") & F.col("query_has_future_alarms") & F.col("candidate_outcome_is_complete") & available
    score = F.when(eligible, jaccard(F.col("__qc"), F.col("__cc")))
    return joined.select(
        *results.columns, "query_outcome_is_complete", "query_has_future_alarms", "candidate_outcome_is_complete", available.alias("candidate_outcome_available_before_query"),
        eligible.alias("evaluation_eligible"), score.alias("outcome_jaccard"), F.lit(float(threshold)).alias("relevance_threshold"), (score >= threshold).alias("is_relevant"),
    )


def query_records(queries: DataFrame, outcomes: DataFrame, found: DataFrame, search: Search, feature_version: str) -> DataFrame:
    """One row a query and threshold, with status and ranking measures; ``queries`` has incident_id and split."""
    k = float(search.k)
    joined = queries.select("incident_id", "split").join(outcomes.select("incident_id", "outcome_is_complete", "has_future_alarms"), "incident_id").join(found, "incident_id", "left")
    pool = F.coalesce("pool", F.lit(0))
    status = F.when(~F.col("outcome_is_complete"), STATUSES[0]).when(~F.col("has_future_alarms"), STATUSES[1]).when(pool == 0, STATUSES[2]).otherwise(STATUSES[3])
    step = joined.withColumn("status", status).withColumn("evaluated", F.col("status") == STATUSES[3])
    thresholds = F.explode(F.array(*(F.struct(F.lit(float(t)).alias("relevance_threshold"), F.lit(i).alias("i")) for i, t in enumerate(search.thresholds))))
    step = step.withColumn("t", thresholds).withColumn("evaluable_candidate_count", F.when(F.col("evaluated"), pool).otherwise(F.lit(0)).cast("long"))
    step = step.withColumn("total_relevant_candidate_count", F.when(F.col("evaluated"), F.coalesce(F.get("relevant", F.col("t.i")), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    labels = F.transform(F.col("best"), lambda b: b["jaccard"] >= F.col("t.relevance_threshold"))
    step = step.withColumn("labels", F.when(F.col("evaluated"), labels)).withColumn("retrieved", F.size("labels"))
    hits = F.size(F.filter("labels", lambda x: x))
    gain = F.aggregate(F.transform("labels", lambda x, i: F.when(x, 1.0 / F.log2(i.cast("double") + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    first = F.array_position("labels", F.lit(True))
    step = step.withColumns({"hits": F.when(F.col("evaluated"), hits), "gain": F.when(F.col("evaluated"), gain), "first": F.when(F.col("evaluated"), first)})
    total = F.col("total_relevant_candidate_count")
    ideal_count = F.least(F.lit(search.k), total)
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(search.k)), F.lit(0.0), lambda a, i: a + F.when(i <= ideal_count, 1.0 / F.log2(i.cast("double") + 1.0)).otherwise(0.0))
    share = ratio(total, F.col("evaluable_candidate_count"))
    expected = F.when(F.col("evaluated"), F.least(F.lit(search.k), F.col("evaluable_candidate_count")).cast("double") / k * share)
    precision = F.col("hits") / F.lit(k)
    known = F.when(F.col("evaluated"), F.nullif(total, F.lit(0)))
    return step.select(
        F.col("incident_id").alias("query_incident_id"), "split", F.col("t.relevance_threshold").alias("relevance_threshold"), "status", F.lit(search.k).alias("k"), F.lit(search.policy).alias("candidate_policy"),
        F.lit(feature_version).alias("feature_version"), "evaluable_candidate_count", "total_relevant_candidate_count", share.alias("relevant_candidate_share"),
        F.when(F.col("evaluated"), F.col("retrieved").cast("double")).alias("retrieved_count"), F.col("hits").cast("double").alias("relevant_retrieved_count"),
        (F.col("hits") > 0).cast("double").alias("hit_at_k"), precision.alias("precision_at_k"), (F.col("hits") / known).alias("recall_at_k"), (ideal_count / known).alias("maximum_recall_at_k"),
        (F.col("hits") / F.when(known.isNotNull(), ideal_count)).alias("recall_efficiency_at_k"), expected.alias("expected_random_precision_at_k"), ratio(precision, expected).alias("precision_lift_at_k"),
        F.when(F.col("evaluated"), F.when(F.col("first") > 0, 1.0 / F.col("first")).otherwise(F.lit(0.0))).alias("reciprocal_rank"), F.when(F.col("evaluated"), F.col("gain") / F.nullif(ideal, F.lit(0.0))).alias("ndcg_at_k"),
    )


MEANS = ("hit_at_k", "precision_at_k", "recall_at_k", "relevant_candidate_share", "maximum_recall_at_k", "recall_efficiency_at_k", "expected_random_precision_at_k", "precision_lift_at_k", "reciprocal_rank", "ndcg_at_k")


def split_metrics(records: DataFrame, by: tuple[str, ...] = ("split",)) -> DataFrame:
    """Coverage over all queries and means over those that have a value, a row for each of ``by``."""
    n = F.count(F.lit(1))
    relevant = F.count_if((F.col("status") == STATUSES[3]) & (F.col("total_relevant_candidate_count") > 0))
    return records.groupBy(*by).agg(
        n.alias("query_count"), F.count_if(F.col("status") == STATUSES[3]).alias("evaluated_query_count"), ratio(F.count_if(F.col("status") == STATUSES[3]), n).alias("evaluation_coverage"),
        *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES[:3]), relevant.alias("query_with_relevant_candidates_count"), ratio(relevant, n).alias("relevant_candidate_query_share"),
        *(F.avg(m).alias(f"mean_{m}") for m in MEANS),
    )


#: Measures of a result table and their short names in reports on the first five candidates.
DIAGNOSTICS = {
    "feature_version": "feature_version",
    "future_horizon_hours": "horizon_h",
    "relevance_threshold": "threshold",
    "evaluation_coverage": "coverage",
    "relevant_candidate_query_share": "relevant_query_share",
    "mean_relevant_candidate_share": "relevant_candidate_share",
    "mean_hit_at_k": "hit_at_5",
    "mean_precision_at_k": "precision_at_5",
    "mean_expected_random_precision_at_k": "random_precision_at_5",
    "mean_precision_lift_at_k": "precision_lift_at_5",
    "mean_recall_at_k": "recall_at_5",
    "mean_maximum_recall_at_k": "max_recall_at_5",
    "mean_recall_efficiency_at_k": "recall_efficiency_at_5",
    "mean_reciprocal_rank": "mrr",
    "mean_ndcg_at_k": "ndcg_at_5",
}


def diagnostics(results: DataFrame) -> DataFrame:
    """The measures that tell how good the first five are, by their short names."""
    missing = sorted(set(DIAGNOSTICS) - set(results.columns))
    if missing:
        raise ValueError(f"measures are missing: {', '.join(missing)}")
    return results.select(*(F.col(c).alias(name) for c, name in DIAGNOSTICS.items()))
