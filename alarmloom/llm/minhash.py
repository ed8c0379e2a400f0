"""Near-duplicates by an inverted index over the coordinates of MinHash signatures.

A text's signature has COORDINATES minimum hashes of its set of two-word shingles. Two sets of similarity s agree in each
coordinate with chance s; pairs that agree in at least MATCHES coordinates are candidates, and those are confirmed
on their whole sets. MATCHES is the largest number that a pair just at the threshold misses with a chance below MISS.

* Prefix: coordinate-value pairs are ordered by how often they occur. Two signatures with MATCHES pairs in common share one
  of the COORDINATES - MATCHES + 1 rarest of each, so documents are posted under those alone.
* Skip: the frequent coordinates have no lists that would have to be merged; they are counted for a pair only
  when it meets in some list, from the signatures that the postings carry (a byte a coordinate; bytes that agree by chance
  add candidates and lose none). Lists of one document are dropped.
* Sizes of similar sets lie within the similarity of each other. A list of over BLOCK documents is cut into bands of sizes, each of which
  meets the next one, and inside a list documents stand in the order of sizes.
* A list gives not its candidate pairs but a forest of them, from the bytes alone; blocks of a long band meet each other where their
  documents are still in several trees. The components of all forests are trunks: a pair of candidates is in one trunk.
* Whole sets are compared inside trunks, not inside lists, so a document that is in many lists moves once. A trunk of up to TEXTS
  documents is a cell. A larger one is dealt to cells by hash, each with the same few hubs, which join what is dense; then those outside the
  trunk's largest component meet the whole trunk, block by block. Only where a large trunk is so sparse that its lists hold
  fewer rows than that, pairs are looked at in lists, each in the first one that it shares.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import checkpointed, join_spread, likely_rows
from .graph import connected_components
from .phrases import Names, paired
from .words import parts_of

COORDINATES, LEAST, MISS = 32, 80, 1e-7
#: Postings in a block of a list; documents and shingles in a block of a trunk; documents that all blocks of a trunk get, about.
BLOCK, TEXTS, SHINGLES, HUBS = 2048, 256, 1 << 17, 16
COUNTERS = 1 << 20
TIMES, PLUS = np.random.default_rng(42).integers(0, 1 << 64, (2, COORDINATES, 1), dtype=np.uint64) | np.uint64(1)
POSTING = "token long, node long, size long, marks binary"


def matches_needed(least: int = LEAST, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most agreeing coordinates that a pair of similarity ``least`` per cent fails to reach with a chance below ``miss``."""
    s, below, t = least / 100, 0.0, 0
    while t < coordinates:
        below += math.comb(coordinates, t) * s**t * (1 - s) ** (coordinates - t)
        if below >= miss:
            break
        t += 1
    return max(1, t)


# ---------------------------------------------------------------- sets and signatures


def shingle_set(text: bytes, names: Names) -> np.ndarray:
    """Sorted distinct hashes of a text's two-word shingles; of its only word if it has one, none without words."""
    found, carried = [], np.zeros(0, np.uint64)
    for part in parts_of(text):
        words = part.lower().split()
        ids = np.concatenate([carried, np.fromiter(map(names.__getitem__, words), np.uint64, len(words))])
        if len(ids) > 1:
            found.append(np.unique(paired(ids[:-1], ids[1:])))
        carried = ids[-1:]
    if not found:
        return carried
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))


def set_name(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, (1 << 32) - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[k : k + 4096] * TIMES + PLUS) >> np.uint64(32)).min(axis=1))
    return least.astype("<u4")


def with_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, size of the set, node (its name) and signature of each whole text; the last two are null without words."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names("")
        for batch in pieces(batches, "text"):
            sizes, nodes, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_set(text, names)
                sizes.append(len(hashes))
                nodes.append(set_name(hashes) if len(hashes) else None)
                signatures.append(signature(hashes).tobytes() if len(hashes) else None)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "size", "node", "signature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, text_hash long, size long, node long, signature binary")


# ---------------------------------------------------------------- inverted index


def tokens_of(signatures: list[bytes]) -> np.ndarray:
    """Coordinate and value of each entry in one number."""
    values = np.frombuffer(b"".join(signatures), "<u4").reshape(-1, COORDINATES).astype(np.int64)
    return values | (np.arange(COORDINATES, dtype=np.int64) << 32)


def counter_of(tokens: np.ndarray) -> np.ndarray:
    return ((tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)  # 20 bits


def token_counts(nodes: DataFrame) -> np.ndarray:
    """How often coordinate-value pairs occur over all nodes, in COUNTERS counters; pairs that share one count together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counts += np.bincount(counter_of(tokens_of(batch.column("signature").to_pylist()).ravel()), minlength=COUNTERS)
        some = np.flatnonzero(counts)
        for k in range(0, len(some), 1 << 17):
            part = some[k : k + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(counts[part])], names=["counter", "n"])

    rows = nodes.select("signature").mapInArrow(count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # COUNTERS rows at most
    out = np.zeros(COUNTERS, np.int64)
    out[rows["counter"].to_numpy()] = rows["n"].to_numpy()
    return out


def rarest(tokens: np.ndarray, counts: np.ndarray, needed: int) -> np.ndarray:
    """Coordinates under which each row is posted: those of its COORDINATES - needed + 1 rarest pairs."""
    return np.lexsort((tokens, counts[counter_of(tokens)]), axis=1)[:, : COORDINATES - needed + 1]


def postings(nodes: DataFrame, shared: Broadcast, needed: int) -> DataFrame:
    """Each node under its rarest coordinate-value pairs, with a byte of each coordinate."""
    prefix = COORDINATES - needed + 1

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                tokens = tokens_of(batch.column("signature").to_pylist())
                order = rarest(tokens, shared.value, needed)
                marks = (tokens & 255).astype(np.uint8)
                repeated = np.repeat(np.arange(batch.num_rows), prefix)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COORDINATES), batch.num_rows, [None, pa.py_buffer(marks.tobytes())]).cast(pa.binary())
                columns = [pa.array(np.take_along_axis(tokens, order, 1).ravel()), batch.column("node").take(pa.array(repeated)), batch.column("size").take(pa.array(repeated)), fixed.take(pa.array(repeated))]
                yield pa.RecordBatch.from_arrays(columns, names=["token", "node", "size", "marks"])

    return nodes.select("node", "size", "signature").mapInArrow(post, POSTING)


def components_of(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place that each of ``n`` places is joined to by the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        new = new[label]
        if np.array_equal(new, label):
            return label
        label = new


def near(marks: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, needed: int, least: int) -> np.ndarray:
    """Which of the pairs (i, j) agree in enough coordinates and have sizes that allow the similarity."""
    out = 100 * np.minimum(sizes[i], sizes[j]) >= least * np.maximum(sizes[i], sizes[j])
    at = np.flatnonzero(out)
    out[at] = (marks[i[at]] == marks[j[at]]).sum(axis=1) >= needed
    return out


def places(run: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in one run of equal numbers in ``run`` whose sizes allow the similarity, next neighbours first. Rows are sorted by run and size."""
    i, d = np.arange(len(run)), 0
    while True:
        d += 1
        i = i[i + d < len(run)]
        i = i[(run[i] == run[i + d]) & (100 * sizes[i] >= least * sizes[i + d])]
        if not len(i):
            return
        yield i, i + d


def candidate_pairs(run: np.ndarray, marks: np.ndarray, sizes: np.ndarray, needed: int, least: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places in one run of equal numbers in ``run`` that are candidates; none of equal numbers in ``skip``. Rows are sorted by run and size."""
    left, right = [], []
    for i, j in places(run, sizes, least):
        asked = np.ones(len(i), bool) if skip is None else skip[i] != skip[j]
        some = near(marks, sizes, i[asked], j[asked], needed, least)
        left.append(i[asked][some])
        right.append(j[asked][some])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def candidate_forest(run: np.ndarray, marks: np.ndarray, sizes: np.ndarray, needed: int, least: int, roots: np.ndarray) -> np.ndarray:
    """The smallest place that each is joined to by candidate pairs of different ``roots`` in its run; pairs that are joined by then are not looked at."""
    label = np.arange(len(run))
    for i, j in places(run, sizes, least):
        asked = (label[i] != label[j]) & (roots[i] != roots[j])
        i, j = i[asked], j[asked]
        some = near(marks, sizes, i, j, needed, least)
        if some.any():
            label = components_of(len(run), label[i[some]], label[j[some]])[label]
    return label


def by_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal ``keys``, several at a time, with their numbers; input is sorted by ``keys``."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        changed = np.zeros(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        last = int(np.flatnonzero(changed)[-1]) if changed.any() else 0
        if last:
            yield table.slice(0, last).combine_chunks(), np.cumsum(changed)[:last]
        held = table.slice(last).combine_chunks()
    if held is not None and held.num_rows:
        yield held, np.zeros(held.num_rows, np.int64)


def columns_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(-1, COORDINATES)
    return table.column("node").to_numpy(), table.column("size").to_numpy(), marks


def in_cells(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys, "size", "node")


LIST, CELL = ("token", "band"), ("token", "band", "i", "j")


def in_bands(live: DataFrame, least: int, block: int) -> DataFrame:
    """``live`` (stored: token, node, size, marks and n, the length of the list) as lists (token, band) of length n, in blocks.

    Lists of ``block`` and less are one band. In others a document stands in the band of its size and in the next
    one, so two sizes that allow the similarity are in one band.
    """
    short = live.where(F.col("n") <= block).select("token", F.lit(0).cast("long").alias("band"), "node", "size", "marks", "n")
    width = max(math.log(100 / least), 0.01) * (1 + 1e-9)
    own = F.floor(F.log("size") / width)
    long_ = live.where(F.col("n") > block).drop("n").withColumn("band", F.explode(F.array(own, own + 1)))
    counts = long_.groupBy(*LIST).agg(F.count("*").alias("n")).where("n > 1")
    both = short.unionByName(checkpointed(long_.join(counts, list(LIST))))
    return both.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block).cast("long")))


def candidate_trees(rows: DataFrame, keys: tuple[str, ...], needed: int, least: int) -> DataFrame:
    """Distinct links (a, b) that join what the candidate pairs of different ``root`` join inside each of the cells that ``keys`` tell apart."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in by_runs(batches, list(keys)):
            nodes, sizes, marks = columns_of(table)
            roots = table.column("root").to_numpy()
            label = candidate_forest(run, marks, sizes, needed, least, roots)
            moved = np.flatnonzero(roots[label] != roots)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])

    return in_cells(rows.select(*keys, "node", "size", "marks", "root"), *keys).mapInArrow(join, "a long, b long").distinct()


def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of each node, itself if ``roots`` (node, root) have none."""
    held = roots.select(F.col("node").alias("of"), F.col("root").alias("its"))
    return rows.join(held, F.col("node") == F.col("of"), "left").withColumn("root", F.coalesce("its", "node")).drop("of", "its")


def numbers_to(n: str) -> Column:
    """0 to ``n`` - 1, a row each."""
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def candidate_links(live: DataFrame, needed: int, least: int, block: int) -> DataFrame:
    """Links (a, b), stored, that join what all candidate pairs in the lists of ``live`` join."""
    trees = checkpointed(candidate_trees(live.withColumn("root", F.col("node")), (*LIST, "block"), needed, least))
    long_ = live.where(F.col("n") > block)
    if long_.isEmpty():
        return trees
    # bands of several blocks and trees: a pair that is apart has a document outside the largest tree
    long_ = checkpointed(with_root(long_, checkpointed(connected_components(trees))))
    held = long_.groupBy(*LIST, "root").agg(F.count("*").alias("own"), F.max("n").alias("of_n")).groupBy(*LIST).agg(F.max_by("root", "own").alias("main"), (F.max("of_n") - F.max("own")).alias("outside"))
    mixed = long_.join(checkpointed(held.where("outside > 0")), list(LIST)).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
    names = [*LIST, "i", "j", "node", "size", "marks", "root"]
    # few outside: those visit all blocks, and nobody else moves
    few = mixed.where(F.col("outside") <= block).withColumn("j", F.lit(-1).cast("long"))
    guests = few.where("root <> main").withColumn("i", numbers_to("blocks")).where("block <> i")
    # many: each two blocks
    across = mixed.where(F.col("outside") > block).withColumn("other", numbers_to("blocks")).where("block <> other").withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    cells = few.withColumn("i", F.col("block")).select(names).unionByName(guests.select(names)).unionByName(across.select(names))
    return checkpointed(trees.unionByName(candidate_trees(cells, CELL, needed, least)))


def unjoined_in_cells(cells: DataFrame, shared: Broadcast, needed: int, least: int) -> DataFrame:
    """Rows (CELL, node, size, signature, root) that are in a candidate pair of different roots in their cell, if the cell is of the first list that the pair shares."""
    names = [*CELL, "node", "size", "signature", "root"]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, run in by_runs(batches, list(CELL)):
            _, sizes, marks = columns_of(table)
            i, j = candidate_pairs(run, marks, sizes, needed, least, table.column("root").to_numpy())
            if not len(i):
                continue
            some, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            chosen = table.take(pa.array(some)).combine_chunks()
            tokens = tokens_of(chosen.column("signature").to_pylist())
            posted = np.zeros(tokens.shape, bool)
            np.put_along_axis(posted, rarest(tokens, shared.value, needed), True, axis=1)
            coordinate = chosen.column("token").to_numpy() >> 32
            left, right = at[: len(i)], at[len(i) :]
            first = np.concatenate([((tokens[a] == tokens[b]) & posted[a] & posted[b]).argmax(axis=1) for a, b in zip(np.array_split(left, 1 + len(i) // 65_536), np.array_split(right, 1 + len(i) // 65_536))])
            own = first == coordinate[left]
            yield from chosen.select(names).take(pa.array(np.union1d(left[own], right[own]))).combine_chunks().to_batches()

    return in_cells(cells.select(*names, "marks"), *CELL).mapInArrow(pick, "token long, band long, i long, j long, node long, size long, signature binary, root long")


# ---------------------------------------------------------------- confirmation on whole sets


def sets_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node and set of the nodes in ``wanted``, read from one text of each; other texts are not shuffled."""
    keys = checkpointed(nodes.join(wanted.select("node").distinct(), "node").select(F.xxhash64("first.doc_id", "first.text_hash").alias("wanted")))
    text = F.coalesce("text", F.lit(""))
    source = docs.select(F.xxhash64("doc_id", F.xxhash64(text)).alias("key"), text.cast("binary").alias("text"))
    found = likely_rows(source, "key", keys, "wanted").join(keys, F.col("key") == F.col("wanted"), "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names("")
        for batch in pieces(batches, "text"):
            found = [shingle_set(x, names) for x in batch.column("text").to_pylist()]
            found = [x for x in found if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["node", "shingles"])

    return checkpointed(found.select("text").mapInArrow(work, "node long, shingles binary").dropDuplicates(["node"]))


def cell_links(table: pa.Table, needed: int, least: int) -> pa.Table:
    """Links (a, b) that join what the similar pairs of one cell join, but for pairs of one ``root``.

    Pairs are candidates whose sets have at least ``least`` per cent of their union in common. All pairs count if all rows are
    of ``side`` 0; else those of a row of side 0 with one of side 2, or with one of side 1 and a greater node.
    """
    names, sizes, side, group = (table.column(c).to_numpy() for c in ("node", "size", "side", "root"))
    group = group.copy()
    signs = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
    at, a, b = np.arange(len(names)), [], []
    starts = np.concatenate([[0], np.cumsum(sizes)])
    codes = marked = None
    for x in np.flatnonzero(side == 0):
        others = at > x if not side.any() else (side == 2) | ((side == 1) & (names > names[x]))
        others = np.flatnonzero(others & (group != group[x]) & (100 * np.minimum(sizes, sizes[x]) >= least * np.maximum(sizes, sizes[x])))
        others = others[(signs[others] == signs[x]).sum(axis=1) >= needed]
        if not len(others):
            continue
        if codes is None:
            codes = np.unique(np.frombuffer(b"".join(table.column("shingles").to_pylist()), np.uint64), return_inverse=True)[1]
            marked = np.zeros(codes.max() + 1, np.int32)
        own = codes[starts[x] : starts[x + 1]]
        marked[own] = 1
        common = np.add.reduceat(marked[codes], starts[:-1])[others]
        marked[own] = 0
        for y in others[100 * common >= least * (sizes[x] + sizes[others] - common)]:
            if group[y] != group[x]:
                a.append(int(names[x]))
                b.append(int(names[y]))
                group[group == group[y]] = group[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def links_in(cells: DataFrame, keys: tuple[str, ...], sets: DataFrame, needed: int, least: int) -> DataFrame:
    """Links (a, b) of the cells that ``keys`` tell apart (node, size, signature, root, side)."""
    rows = cells.select(*keys, "node", "size", "signature", "root", "side").join(sets, "node")
    return rows.groupBy(*keys).applyInArrow(lambda table: cell_links(table, needed, least), "a long, b long")


def blocks_of(count: Column, shingles: Column, texts: int) -> Column:
    return F.greatest(F.ceil(count / texts), F.ceil(shingles / SHINGLES)).cast("long")


def links_in_lists(rows: DataFrame, nodes: DataFrame, sets: DataFrame, shared: Broadcast, needed: int, least: int, texts: int) -> DataFrame:
    """Links of the postings in ``rows`` (LIST, node, size, marks, n, root): blocks of ``texts`` inside, and with each other where a list holds several roots."""
    mixed = rows.groupBy(*LIST).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(*LIST)
    dealt = checkpointed(rows.join(mixed, list(LIST)).withColumn("blocks", F.ceil(F.col("n") / texts).cast("long")).withColumn("own", F.pmod(F.xxhash64("node"), "blocks")))
    cells = dealt.withColumn("other", numbers_to("blocks")).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    signed = cells.select(*CELL, "node", "size", "marks", "root").join(nodes.select("node", "signature"), "node")
    found = checkpointed(unjoined_in_cells(signed, shared, needed, least).withColumn("side", F.lit(0)))
    # of cells with the same nodes one is enough
    same = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("n"))
    once = found.groupBy(*CELL).agg(*same).groupBy("n", "x", "y").agg(F.min(F.struct(*CELL)).alias("cell")).select("cell.*")
    return links_in(found.join(once, list(CELL)), CELL, sets, needed, least)


def set_links(docs: DataFrame, nodes: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes that join what all pairs of sets with similarity ``least`` per cent join.

    ``nodes`` (node, size, signature, first.doc_id, first.text_hash) should be stored.
    """
    needed, texts = matches_needed(least), min(TEXTS, block)
    shared = nodes.sparkSession.sparkContext.broadcast(token_counts(nodes))  # COUNTERS numbers
    posted = postings(nodes, shared, needed)
    lists = checkpointed(posted.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select(F.col("token").alias("of"), "n"))
    live = in_bands(checkpointed(posted.join(lists, F.col("token") == F.col("of")).drop("of")), least, block)
    trunks = connected_components(candidate_links(live, needed, least, block)).select("node", F.col("root").alias("trunk"))
    placed = checkpointed(trunks.join(nodes.select("node", "size", "signature"), "node").withColumn("root", F.col("node")))
    sets = sets_of(docs, nodes, placed)

    # cells of whole trunks, and of blocks of large ones with the trunk's hubs
    large = placed.groupBy(F.col("trunk").alias("of")).agg(F.count("*").alias("n"), blocks_of(F.count("*"), F.sum("size"), texts).alias("blocks")).where("blocks > 1")
    large = checkpointed(large)  # a row a block at most, as the others are left out
    dealt = placed.join(F.broadcast(large), F.col("trunk") == F.col("of"), "left").drop("of").withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))))
    hubs = dealt.where("blocks > 1").where(F.pmod(F.xxhash64("node", F.lit(1)), "n") < HUBS).withColumn("i", numbers_to("blocks")).where("i <> own")
    names = ["trunk", "i", "node", "size", "signature", "root"]
    cells = dealt.withColumn("i", F.col("own")).select(names).unionByName(hubs.select(names)).withColumn("side", F.lit(0))
    links = checkpointed(links_in(cells, ("trunk", "i"), sets, needed, least))
    if large.isEmpty():
        return links

    # of large trunks, documents outside the largest component meet all
    roots = checkpointed(connected_components(links))
    open_ = checkpointed(with_root(dealt.where("blocks > 1").drop("root"), roots))
    parts = open_.groupBy("trunk", "n", "blocks", "root").agg(F.count("*").alias("own_n"), F.sum("size").alias("own_size"))
    main = F.max(F.struct("own_n", "root", "own_size"))
    held = parts.groupBy("trunk", "n", "blocks").agg(main.alias("main"), (F.col("n") - main["own_n"]).alias("out_n"), (F.sum("own_size") - main["own_size"]).alias("out_size")).where("out_n > 0")
    held = held.select(F.col("trunk").alias("of"), F.col("main.root").alias("main"), blocks_of(F.col("out_n"), F.col("out_size"), texts).alias("out_blocks"), (F.col("out_n") * F.col("blocks") + F.col("n") * blocks_of(F.col("out_n"), F.col("out_size"), texts)).alias("cost"), "n")
    held = checkpointed(held)

    # a document has COORDINATES - needed + 1 postings: only beyond that lists may hold fewer rows than the trunk's blocks
    costly = held.where(F.col("cost") > (COORDINATES - needed + 1) * F.col("n"))
    sparse = None if costly.isEmpty() else checkpointed(sparse_trunks(live, open_, costly, texts))
    in_blocks = held if sparse is None else held.join(sparse, F.col("of") == F.col("by_lists"), "left_anti")
    met = open_.join(F.broadcast(in_blocks.drop("n")), F.col("trunk") == F.col("of"))
    guests = met.where("root <> main").withColumn("i", F.pmod(F.xxhash64("node", F.lit(2)), "out_blocks")).withColumn("j", numbers_to("blocks")).withColumn("side", F.lit(0))
    hosts = met.withColumn("i", numbers_to("out_blocks")).withColumn("j", F.col("own")).withColumn("side", F.when(F.col("root") == F.col("main"), 2).otherwise(1))
    names = ["trunk", "i", "j", "node", "size", "signature", "root", "side"]
    links = links.unionByName(links_in(guests.select(names).unionByName(hosts.select(names)), ("trunk", "i", "j"), sets, needed, least))
    if sparse is None:
        return links
    apart = open_.join(F.broadcast(sparse), F.col("trunk") == F.col("by_lists")).select(F.col("node").alias("open"), "root")
    rows = live.drop("block").join(apart, F.col("node") == F.col("open")).drop("open")
    return links.unionByName(links_in_lists(rows, nodes, sets, shared, needed, least, texts))


def sparse_trunks(live: DataFrame, open_: DataFrame, held: DataFrame, texts: int) -> DataFrame:
    """Those trunks of ``held`` (of, cost) whose lists, each two blocks of ``texts`` of a list, take fewer rows than ``cost``, as by_lists."""
    members = open_.join(F.broadcast(held.select("of", "cost")), F.col("trunk") == F.col("of")).select(F.col("node").alias("open"), "of", "cost")
    rows = live.join(members, F.col("node") == F.col("open"))
    return rows.groupBy("of").agg(F.sum(F.ceil(F.col("n") / texts)).alias("rows"), F.max("cost").alias("cost")).where("rows < cost").select(F.col("of").alias("by_lists"))


def component_report(docs: DataFrame, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id reached over links, itself included) and kept.

    A document is kept if it has its component's smallest doc_id. Null and empty texts and those without words have no
    set and are linked with nothing; a text of one word has a set of that word. Texts with the same set, repeated rows
    among them, are one node of the search. Long texts are read whole, in parts. A null doc_id never is a component's,
    unless all are null. Sets are compared by 64-bit hashes of shingles, and told apart by one of the set. An empty
    table gives no rows; other columns are not looked at.
    """
    prints = checkpointed(with_signatures(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash"))
    known = prints.where(F.col("node").isNotNull())
    nodes = checkpointed(known.groupBy("node").agg(first.alias("first"), F.any_value("size").alias("size"), F.any_value("signature").alias("signature")))
    joined = connected_components(set_links(docs, nodes, least, block)).select(F.col("node").alias("of"), "root")
    rooted = checkpointed(nodes.select("node", F.col("first.doc_id").alias("doc_id")).join(joined, F.col("node") == F.col("of"), "left").select("node", "doc_id", F.coalesce("root", "node").alias("root")))
    least_id = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("root", "top")
    of_node = checkpointed(join_spread(rooted, least_id, "root", "top").select(F.col("node").alias("of"), "component_id"))
    with_words = join_spread(checkpointed(known.select("doc_id", "size", "node")), of_node, "node", "of").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
    alone = prints.where(F.col("node").isNull()).select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


#: The same report in SQL, over all pairs that share a shingle; for tables whose rows differ in doc_id.
REPORT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT r.x, b.y FROM reached r JOIN ways b ON r.y = b.x
), least AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reached GROUP BY x
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN sizes USING (doc_id)
"""
