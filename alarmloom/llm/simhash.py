"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints of 64 bits that differ in ``most`` bits or fewer are linked. Anchors
are the words of a linear code. Each fingerprint belongs to one of the anchors nearest
to it; call their distance its radius. If x and y are linked and x has the smaller
radius r, y is within r + most of x's anchor, and so within its own radius plus
``most``. So each fingerprint is sent to every anchor within its own radius
plus ``most`` (never more than the code's covering radius plus ``most``), and every
link shows up at the anchor of one of its ends, where those that belong there
are compared with all that were sent there. An anchor gives out not all its links but a
tree of them: one row at most for each fingerprint sent there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import checkpointed, columns_of, join_spread, shuffle_partitions, temp_names
from .graph import connected_components
from .words import parts_of

BITS, MOST, SHINGLE, SEED = 64, 4, 4, 42
#: Exponents of the code's check functions, and the number of code words with them: see ``code_words``.
CODES = ((7, (0, 1)), (10, (0, 1, 9)), (16, (0, 1, 9, 5)))
PER_ANCHOR = 256
#: Fingerprints along a side of a cell.
SIDE = 1 << 14


# ---------------------------------------------------------------- fingerprints


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit, bit 0 first."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[k : k + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def shingle_hashes(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    line = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    digest, size = xxhash.xxh64_intdigest, len(words) - n + 1
    starts = [0] + [e + 1 for e in ends[: size - 1]]
    return np.fromiter([digest(line[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])], np.uint64, size)


def fingerprint(text: bytes) -> int:
    """The SimHash of a whole text, given as UTF-8."""
    counts, total, carried = np.zeros(BITS, np.int64), 0, []
    for part in parts_of(text):
        words = carried + part.lower().split()
        if len(words) >= SHINGLE:
            hashes = shingle_hashes(words)
            counts += bit_counts(hashes)
            total += len(hashes)
            words = words[1 - SHINGLE :]
        carried = words
    if not total:
        if not carried:
            return 0
        counts, total = bit_counts(shingle_hashes(carried, len(carried))), 1
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the fingerprint of the whole text as a signed number; a null text counts as empty."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = np.array([fingerprint(x) for x in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, text_hash long, fingerprint long")


# ---------------------------------------------------------------- anchors


def field_powers() -> list[int]:
    """Powers of a generator of the field of 64 elements."""
    out, x = [], 1
    for _ in range(63):
        out.append(x)
        x <<= 1
        if x & 64:
            x ^= 0b1000011
    return out


def code_words(exponents: tuple[int, ...]) -> np.ndarray:
    """All words of the code whose words are the values, at the 64 field elements, of sums of traces of
    a * x ** e: with exponents 0 and 1 the first-order Reed-Muller code, with 9 the small and with 5 a
    larger Kasami code, each with a bit for parity."""
    powers = field_powers()
    log = {x: i for i, x in enumerate(powers)}

    def times(a: int, b: int) -> int:
        return 0 if not a or not b else powers[(log[a] + log[b]) % 63]

    def trace(x: int) -> int:
        total, y = 0, x
        for _ in range(6):
            total, y = total ^ y, times(y, y)
        return total & 1

    rows = []
    for e in exponents:
        for a in powers[:6] if e else [next(x for x in powers if trace(x))]:
            word = 0
            for x in range(64):
                value = 1 if not e else 0 if not x else powers[(log[x] * e) % 63]
                word |= trace(times(a, value)) << x
            rows.append(word)
    basis: list[int] = []
    for word in rows:
        for b in basis:
            word = min(word, word ^ b)
        if word:
            basis.append(word)
            basis.sort(reverse=True)
    words = np.zeros(1, np.uint64)
    for b in basis:
        words = np.concatenate([words, words ^ np.uint64(b)])
    return words


def anchors(distinct: int) -> np.ndarray:
    """The code with the fewest words of which each stands for at most PER_ANCHOR of ``distinct`` fingerprints, or else the largest code."""
    exponents = next((e for k, e in CODES if distinct <= PER_ANCHOR << k), CODES[-1][1])
    return code_words(exponents)


def sent(fingerprints: np.ndarray, words: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint and each anchor that it is sent to: its place, the anchor's number, and whether it belongs there."""
    rows, columns, own = [], [], []
    step = max(1, (1 << 19) // len(words))
    for k in range(0, len(fingerprints), step):
        apart = np.bitwise_count(fingerprints[k : k + step, None] ^ words[None, :])
        radius = apart.min(axis=1)
        home = apart.argmin(axis=1)
        r, c = np.nonzero(apart <= radius[:, None] + np.uint8(most))
        rows.append(r + k)
        columns.append(c)
        own.append(c == home[r])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(own)


def anchor_links(points: np.ndarray, home: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """A tree for each set of ``points`` that links between those at home here and all join: (point, smallest point of its set)."""
    label = np.arange(len(points))  # points are sorted, so smaller labels are smaller points
    for at in np.array_split(np.flatnonzero(home), max(1, -(-int(home.sum()) * len(points) // (1 << 21)))):
        near = np.bitwise_count(points[at, None] ^ points[None, :]) <= most
        i, j = np.nonzero(near)
        i = at[i]
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, label[i], low)
            np.minimum.at(new, label[j], low)
            new = new[new]
            new = new[label]
            if np.array_equal(new, label):
                break
            label = new
    moved = np.flatnonzero(label != np.arange(len(points)))
    return points[moved], points[label[moved]]


def mixed(values: np.ndarray) -> np.ndarray:
    x = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def anchor_sizes(spread: DataFrame, words, most: int, side: int) -> dict[int, tuple[int, int]]:
    """Blocks of those at home and of all for each anchor with more than ``side`` fingerprints; a row an anchor at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, every = np.zeros(len(words.value), np.int64), np.zeros(len(words.value), np.int64)
        for _, anchor, own in sent_batches(batches, words.value, most):
            home += np.bincount(anchor[own], minlength=len(home))
            every += np.bincount(anchor, minlength=len(every))
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(home[some]), pa.array(every[some])], names=["anchor", "home", "every"])

    counts = spread.mapInArrow(count, "anchor int, home long, every long").groupBy("anchor").agg(F.sum("home").alias("home"), F.sum("every").alias("every"))
    return {r.anchor: (-(-r.home // side), -(-r.every // side)) for r in counts.where((F.col("every") > side) & (F.col("home") > 0)).collect()}


def sent_batches(batches: Iterator[pa.RecordBatch], words: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprint, anchor, whether it belongs there) of what is sent, in runs of bounded size."""
    for batch in batches:
        values = batch.column("fingerprint").to_numpy(zero_copy_only=False)
        for k in range(0, len(values), 4096):
            part = values[k : k + 4096].view(np.uint64)
            row, anchor, home = sent(part, words, most)
            yield part[row], anchor, home


def cells(points: np.ndarray, anchor: np.ndarray, home: np.ndarray, blocks: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell, fingerprint and whether it is at home, for what is sent to anchors.

    An anchor is one cell, unless it is in ``blocks``: then those at home are dealt to rows and all to
    columns by hash, and each row of blocks meets each column in a cell of its own.
    """
    cell, out, own = [anchor.astype(np.int64) << 32], [points], [home]
    hot = np.isin(anchor, np.fromiter(blocks, np.int64, len(blocks)))
    if hot.any():
        cell, out, own = [cell[0][~hot]], [points[~hot]], [home[~hot]]
        for a in np.unique(anchor[hot]):
            here = anchor == a
            p, is_home, (high, wide) = points[here], home[here], blocks[int(a)]
            hashed = mixed(p)
            i, j = (hashed % np.uint64(high)).astype(np.int64), (hashed // np.uint64(high) % np.uint64(wide)).astype(np.int64)
            base = int(a) << 32
            for column in range(wide):
                cell.append(base + (i[is_home] << 16) + column)
                out.append(p[is_home])
                own.append(np.ones(int(is_home.sum()), bool))
            for row in range(high):
                other = ~(is_home & (i == row))
                cell.append(base + (row << 16) + j[other])
                out.append(p[other])
                own.append(np.zeros(int(other.sum()), bool))
    return np.concatenate(cell), np.concatenate(out), np.concatenate(own)


def near_links(fingerprints: DataFrame, most: int = MOST, side: int = SIDE) -> DataFrame:
    """Links (a, b) between distinct ``fingerprint`` values that join the same sets as all pairs within ``most`` bits.

    An anchor to which more than ``side`` fingerprints are sent is compared in several cells of
    about ``side`` times ``side``, so no task holds a whole hot anchor.
    """
    spark, n = fingerprints.sparkSession, fingerprints.count()
    words = spark.sparkContext.broadcast(anchors(n))  # 2 ** 16 words at most
    spread = fingerprints.select("fingerprint").repartition(shuffle_partitions(spark))
    blocks = spark.sparkContext.broadcast(anchor_sizes(spread, words, most, side))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for points, anchor, home in sent_batches(batches, words.value, most):
            cell, out, own = cells(points, anchor, home, blocks.value)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(out.view(np.int64)), pa.array(own)], names=["cell", "fingerprint", "home"])

    def link(table: pa.Table) -> pa.Table:
        points = table.column("fingerprint").to_numpy()
        order = np.argsort(points)
        a, b = anchor_links(points[order].view(np.uint64), table.column("home").to_numpy(zero_copy_only=False)[order], most)
        return pa.table({"a": pa.array(a.view(np.int64), pa.int64()), "b": pa.array(b.view(np.int64), pa.int64())})

    return spread.mapInArrow(send, "cell long, fingerprint long, home boolean").groupBy("cell").applyInArrow(link, "a long, b long")


def components(prints: DataFrame, most: int = MOST) -> DataFrame:
    """(fingerprint, root) for each fingerprint that is linked to another one; repeated ones count once, and no rows give none."""
    return connected_components(near_links(prints.select("fingerprint").distinct(), most))


def component_ids(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reached over links, for each document.

    Texts without words (null, empty, white space) have fingerprint zero and are linked like any others; long
    texts are hashed whole. Equal fingerprints are one point of the search, so copies cost nothing there.
    A doc_id that is null is never a component's; a component of nothing else has null. An empty table gives no rows;
    other columns of ``docs`` are not looked at.
    """
    prints = checkpointed(with_fingerprints(docs).select("doc_id", "fingerprint"))
    points = checkpointed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    joined = checkpointed(with_roots(points))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "top")
    of_point = checkpointed(join_spread(joined, least, "root", "top").select(F.col("fingerprint").alias("point"), "component_id"))
    out = join_spread(prints, of_point, "fingerprint", "point")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def with_roots(points: DataFrame) -> DataFrame:
    """``points`` with the root of each one's component: itself where it has no links."""
    roots = components(points)
    return points.join(roots, F.col("fingerprint") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fingerprint")).drop("node")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), then text hash.

    Texts without words are one component. Of repeated rows one stays. An empty table gives no rows;
    columns may have any names.
    """
    prints = checkpointed(with_fingerprints(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash"))
    points = checkpointed(prints.groupBy("fingerprint").agg(first.alias("first")))
    kept = with_roots(points).groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    return rows_of(docs, kept)


def rows_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (doc_id, text_hash) of ``kept``."""
    own, key, doc_id, wanted, kept_hash = temp_names(docs, "own_hash", "own_key", "kept_doc", "kept_key", "kept_hash")
    asked = kept.select(F.col("doc_id").alias(doc_id), F.col("text_hash").alias(kept_hash)).withColumn(wanted, F.xxhash64(doc_id, kept_hash))
    # the key never is null, so rows without a doc_id find theirs by an equality too
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit("")))).withColumn(key, F.xxhash64("doc_id", own))
    same = (F.col(key) == F.col(wanted)) & F.col("doc_id").eqNullSafe(F.col(doc_id)) & (F.col(own) == F.col(kept_hash))
    return keyed.join(asked, same, "left_semi").dropDuplicates([key, "doc_id", own]).select(*columns_of(docs))
