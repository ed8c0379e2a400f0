"""Near copies for the corpus pipeline: SimHash links, and texts that share most of their five-word shingles.

Two distinct texts are near copies if the Jaccard similarity of their sets of five-word shingles
(``shingles``) is at least ``LEAST``. Candidates share one of ``BANDS`` bands of ``ROWS`` minimum hashes each,
and every pair of candidates that is not joined already is compared by its whole sets, so no link is false (but
for equal 64-bit hashes). The search by bands can miss: a pair of similarity s is in no common band
with chance (1 - s ** 4) ** 24, which is 3e-6 at 0.8 and less above. Links of SimHash (op9) count besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import checkpointed, likely_rows
from .graph import connected_components
from .simhash import SEED, fingerprint, rows_of, shingle_hashes, with_roots
from .words import parts_of

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: Shingles and texts in a block of a bucket.
BLOCK, TEXTS = 1 << 17, 256
TIMES, PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of all words together if there are fewer, none without words."""
    found, carried = [], []
    for part in parts_of(text):
        words = carried + part.lower().split()
        if len(words) >= SHINGLE:
            found.append(np.unique(shingle_hashes(words, SHINGLE)))
            words = words[1 - SHINGLE :]
        carried = words
    if not found and carried:
        found = [shingle_hashes(carried, len(carried))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def bands(hashes: np.ndarray) -> np.ndarray:
    """A number for each band of minimum hashes; none without hashes."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint64)
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, ((hashes[k : k + 4096] * TIMES + PLUS) >> np.uint64(32)).min(axis=1))
    rows = least.astype("<u4").reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), b) for b, row in enumerate(rows)], np.uint64).view(np.int64)


def with_sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fingerprint, the number of shingles and the bands of the whole text; a null text counts as empty, which has no bands. A row a row; other columns are not looked at."""
    text = F.coalesce("text", F.lit(""))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            prints = np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64)
            sizes, found = [], []
            for x in texts:
                hashes = shingles(x)
                sizes.append(len(hashes))
                found.append(bands(hashes))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(prints), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fingerprint", "size", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, text_hash long, fingerprint long, size long, bands array<long>")


def copy_links(sets: list[np.ndarray], labels: np.ndarray, least: float = LEAST, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between ``labels`` that join those of all pairs of ``sets`` with similarity ``least`` or more; with ``side``, of pairs of two sides."""
    sizes = np.array([len(x) for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    names, group = np.unique(labels, return_inverse=True)
    links, marked = [], np.zeros(len(values), np.int32)
    for x in np.flatnonzero(group != np.bincount(group).argmax()):  # pairs inside the largest set are joined already
        other = group != group[x] if side is None else (group != group[x]) & (side != side[x])
        if not other.any():
            continue
        own = codes[starts[x] : starts[x] + sizes[x]]
        marked[own] = 1
        common = np.add.reduceat(marked[codes], starts)
        marked[own] = 0
        for g in np.unique(group[other & (common / (sizes[x] + sizes - common) >= least)]):
            links.append((int(names[g]), int(names[group[x]])))
            group[group == g] = group[x]
    return links


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_hash and shingles of the texts in ``wanted`` (doc_id, text_hash)."""
    text = F.coalesce("text", F.lit(""))
    keys = checkpointed(wanted.select(F.xxhash64("doc_id", "text_hash").alias("wanted")))
    source = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    source = likely_rows(source.withColumn("key", F.xxhash64("doc_id", "text_hash")), "key", keys, "wanted").join(keys, F.col("key") == F.col("wanted"), "left_semi").select("text_hash", "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = [shingles(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(found, pa.binary())], names=["text_hash", "shingles"])

    return checkpointed(source.mapInArrow(work, "text_hash long, shingles binary").dropDuplicates(["text_hash"]))


def root_links(docs: DataFrame, texts: DataFrame, rooted: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between roots of SimHash components that hold near copies.

    Buckets of one root hold nothing new, and of buckets with the same texts one is enough. A large
    bucket is cut into blocks, which are compared inside first; then each two blocks are a group of
    their own, if they are not one component by then.
    """
    members = texts.join(rooted.select("fingerprint", "root"), "fingerprint").select("text_hash", "root", "size", F.explode("bands").alias("bucket"))
    mixed = members.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    live = checkpointed(members.join(mixed, "bucket"))
    marks = (F.bit_xor(F.xxhash64("text_hash")).alias("x"), F.bit_xor(F.xxhash64("text_hash", F.lit(1))).alias("y"))
    each = live.groupBy("bucket").agg(F.count("*").alias("n"), *marks, F.sum("size").alias("total"))
    once = checkpointed(each.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket"), F.greatest(F.ceil(F.min("total") / BLOCK), F.ceil(F.min("n") / TEXTS)).cast("long").alias("blocks")).select("bucket", "blocks"))
    # blocks differ from bucket to bucket, so what several buckets hold is joined by the blocks of the others
    live = checkpointed(live.join(once, "bucket").withColumn("i", F.pmod(F.xxhash64("text_hash", "bucket"), "blocks")))
    wanted = texts.join(live.select("text_hash").distinct(), "text_hash").select("least.doc_id", "text_hash")
    sets = sets_of(docs, wanted)

    def link(table: pa.Table) -> pa.Table:
        found = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        side = table.column("side").to_numpy()
        links = copy_links(found, table.column("root").to_numpy(), least, side if len(np.unique(side)) > 1 else None)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    def linked(cells: DataFrame) -> DataFrame:
        return cells.join(sets, "text_hash").groupBy("bucket", "i", "j").applyInArrow(link, "a long, b long")

    inside = checkpointed(linked(live.select("bucket", "i", F.col("i").alias("j"), "text_hash", "root", F.col("i").alias("side"))))
    tops = connected_components(inside).select("node", F.col("root").alias("top"))
    rest = live.where("blocks > 1").join(tops, F.col("root") == F.col("node"), "left").withColumn("root", F.coalesce("top", "root"))
    # each two blocks of a bucket, where they hold what is not joined yet
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("i <> other")
    cells = checkpointed(rest.select("bucket", F.least("i", "other").alias("low"), F.greatest("i", "other").alias("j"), "text_hash", "root", F.col("i").alias("side")).withColumnRenamed("low", "i"))
    apart = cells.groupBy("bucket", "i", "j").agg(F.min("root").alias("least_root"), F.max("root").alias("most_root")).where("least_root < most_root").select("bucket", "i", "j")
    return inside.unionByName(linked(cells.join(apart, ["bucket", "i", "j"])))


def drop_near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """``docs`` with one row of each set that links of SimHash and of near copies join: that of the smallest doc_id (null last), then text hash.

    Texts without words (null, empty, white space) are one set; long texts count whole. Of
    repeated rows one stays. An empty table gives no rows; columns may have any names.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id"))
    same = (F.any_value(c).alias(c) for c in ("fingerprint", "size", "bands"))
    texts = checkpointed(with_sketches(docs).groupBy("text_hash").agg(first.alias("least"), *same))
    points = texts.groupBy("fingerprint").agg(F.min(F.struct("least", "text_hash")).alias("first"))
    rooted = checkpointed(with_roots(checkpointed(points)))
    joined = connected_components(root_links(docs, texts, rooted, least)).select("node", F.col("root").alias("top"))
    sets = rooted.join(joined, F.col("root") == F.col("node"), "left").groupBy(F.coalesce("top", "root").alias("top")).agg(F.min("first").alias("first"))
    return rows_of(docs, sets.select("first.least.doc_id", "first.text_hash"))
