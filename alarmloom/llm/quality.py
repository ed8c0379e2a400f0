"""Importance resampling: hashed n-gram models of target and raw text, their ratio as a document's weight, Gumbel top-k as the draw.

Both models are bags of n-grams hashed into a fixed number of buckets: words,
pairs of words and runs of three bytes. The raw model counts every document; the
target model counts the documents that labels call good, of which at most
``max_labelled`` are used. A document's log weight is the sum of the log ratios of its
n-grams. Adding Gumbel noise to it and keeping the k largest draws k documents
without replacement with probabilities in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .arrow import pieces
from .common import columns_of, numbered, prefix_sums, temp_names
from .words import parts_of

WORD_BUCKETS = BYTE_BUCKETS = 1 << 16
BUCKETS = WORD_BUCKETS + BYTE_BUCKETS
STEP = np.uint64(0x100000001B3)
TURN = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 18
#: Log ratios are whole multiples of 1 / STEPS, so that sums of any 2 ** 28 of them are exact in any order.
STEPS = float(1 << 20)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def step_powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, STEP)])


POWERS = step_powers(256)


NONE = np.zeros(0, np.uint8)


def feature_buckets(data: np.ndarray, ends: np.ndarray, carried: int | None = None, tail: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, int | None]:
    """Buckets of all n-grams of texts that stand one after another in ``data``, and the text of each.

    ``ends``: where each text ends; a white space byte stands last in each text.
    ``carried`` and ``tail``: the hash of the word before the first, and the last two bytes before ``data``,
    if the text goes on from an earlier part. Also gives the hash of the last word.
    """
    owner = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    space = (data == 32) | ((data >= 9) & (data <= 13))
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    found, whose = [], []
    last = carried
    if len(start):
        place = np.arange(len(data)) - np.r_[np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.r_[start, len(data)]))]
        parts = (data.astype(np.uint64) + np.uint64(1)) * POWERS[place & 255]
        parts[space] = 0
        words = mixed(np.add.reduceat(parts, start))
        of = owner[start]
        found.append(words % np.uint64(WORD_BUCKETS))
        whose.append(of)
        left, same = words[:-1], of[1:] == of[:-1]
        found.append((mixed(left * TURN + words[1:]) % np.uint64(WORD_BUCKETS))[same])
        whose.append(of[1:][same])
        if carried is not None:
            found.append(mixed(np.array([carried], np.uint64) * TURN + words[:1]) % np.uint64(WORD_BUCKETS))
            whose.append(of[:1])
        last = int(words[-1])
    whole, owner = np.concatenate([tail, data]), np.concatenate([np.zeros(len(tail), np.int64), owner])
    if len(whole) > 2:
        runs = whole[:-2].astype(np.uint64) | whole[1:-1].astype(np.uint64) << np.uint64(8) | whole[2:].astype(np.uint64) << np.uint64(16)
        same = owner[2:] == owner[:-2]
        found.append((mixed(runs * TURN) % np.uint64(BYTE_BUCKETS) + np.uint64(WORD_BUCKETS))[same])
        whose.append(owner[2:][same])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), last
    return np.concatenate(found).astype(np.int64), np.concatenate(whose), last


def long_batches(text: bytes) -> Iterator[np.ndarray]:
    """The buckets of one long text in parts; together they are those of the text in one piece."""
    carried, tail = None, NONE
    for part in parts_of(text + b" ", CHUNK):
        data = np.frombuffer(part, np.uint8)
        buckets, _, carried = feature_buckets(data, np.array([len(data)]), carried, tail)
        tail = np.concatenate([tail, data[-2:]])[-2:]
        yield buckets


def batches_of(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, number of texts, buckets, text of each bucket from the first) for runs of texts; a long text may come in several."""
    held, size, first = [], 0, 0
    for i, text in enumerate([*texts, None]):
        if held and (text is None or size + len(text) > CHUNK):
            data = np.frombuffer(b"".join(x + b" " for x in held), np.uint8)
            buckets, owner, _ = feature_buckets(data, np.cumsum([len(x) + 1 for x in held]))
            yield first, len(held), buckets, owner
            held, size = [], 0
        if text is None:
            break
        if len(text) > CHUNK:
            for buckets in long_batches(text):
                yield i, 1, buckets, np.zeros(len(buckets), np.int64)
            continue
        if not held:
            first = i
        held.append(text)
        size += len(text)


@dataclass(frozen=True)
class Model:
    """Log ratio of target to raw for each bucket, and the share of labelled documents that are good."""

    log_ratio: np.ndarray
    share: float


def good_sample(labels: DataFrame, max_labelled: int) -> DataFrame:
    """At most ``max_labelled`` doc_ids labelled good, the first by hash."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, prior: float = 100.0) -> Model:
    """Counts both models in one pass over all documents.

    Without good documents all ratios are 1, and without labels the share is 1. A null
    or empty text has no n-grams; repeated rows count each; a long text counts whole, in parts.
    """
    chosen = F.broadcast(good_sample(labels, max_labelled).withColumn("good", F.lit(True)))  # max_labelled rows at most
    tagged = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(chosen, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for batch in pieces(batches, "text"):
            good = np.array(batch.column("good").to_pylist(), bool)
            for first, n, buckets, owner in batches_of(batch.column("text").to_pylist()):
                counts[0] += np.bincount(buckets, minlength=BUCKETS)
                mine = good[first : first + n]
                if mine.any():
                    counts[1] += np.bincount(buckets[mine[owner]], minlength=BUCKETS)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "raw": counts[0][some], "target": counts[1][some]})

    sums = tagged.mapInArrow(count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    got = sums.toPandas()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[got["bucket"].to_numpy(int)], target[got["bucket"].to_numpy(int)] = got["raw"], got["target"]
    ratio = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        r, t = raw[part], target[part]
        if t.sum():
            share = r / r.sum()
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio[part] = np.where(r > 0, np.log((t + prior * share) / (t.sum() + prior) / share), 0.0)
    ratio = np.round(ratio * STEPS) / STEPS
    known = labels.where(F.col("quality").isNotNull()).agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return Model(ratio, 1.0 if known is None else float(known))


def with_log_weights(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` with the log weight of the whole text in ``name``, which must be a new column.

    A text without n-grams (null, empty) has 0, an empty table gives none; equal texts have
    equal weights, however long they are and whatever rows they are read with.
    """
    (body,) = temp_names(docs, "text_bytes")
    table = docs.sparkSession.sparkContext.broadcast(model.log_ratio)  # BUCKETS numbers
    source = docs.withColumn(body, F.coalesce("text", F.lit("")).cast("binary"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = table.value
        for batch in pieces(batches, body):
            sums = np.zeros(batch.num_rows)
            for first, n, buckets, owner in batches_of(batch.column(body).to_pylist()):
                sums[first : first + n] += np.bincount(owner, ratio[buckets], minlength=n)
            columns = [c for c, n in zip(batch.columns, batch.schema.names) if n != body]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums)], names=[*(n for n in batch.schema.names if n != body), "weight"])

    plain, fields = numbered(source, body)
    schema = StructType([*fields[:-1], StructField("weight", DoubleType())])  # the text's bytes came last
    return plain.mapInArrow(score, schema).toDF(*docs.columns, name)


def gumbel_key(log_weight: Column, row: Column) -> Column:
    """The log weight plus Gumbel noise that depends on nothing but the row."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), row), 11).cast("double") + 0.5) / float(1 << 53)
    return log_weight - F.log(-F.log(uniform))


def ranked(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, log_weight, gumbel_key, row_hash, rank and keep of each document."""
    row = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    # the text is hashed before the weights are worked out, so that only short columns go on
    scored = with_log_weights(docs.select("doc_id", "text", row.alias("row_hash")), model, "log_weight").select("doc_id", "row_hash", "log_weight")
    keyed = scored.withColumn("gumbel_key", gumbel_key(F.col("log_weight"), F.col("row_hash")))
    placed = prefix_sums(keyed, [F.col("gumbel_key").desc(), F.col("row_hash")], {"ahead": F.lit(1)})
    most = F.ceil(F.col("ahead_total") * F.lit(model.share))
    return placed.select("doc_id", "log_weight", "gumbel_key", "row_hash", (F.col("ahead") + 1).alias("rank"), (F.col("ahead") < most).alias("keep"))


def resample(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """One row a document: its log weight, its key in the draw, its rank and whether it is drawn.

    As many documents are drawn as there are rows, times the share of labelled
    documents that are good. Equal rows have equal keys and stand side by side. Null and empty texts have weight 0, a null doc_id is a
    document; an empty table gives no rows, and other columns are not looked at.
    """
    return ranked(docs, fit(docs, labels, max_labelled)).select("doc_id", "log_weight", "gumbel_key", "rank", "keep")


def keep_drawn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """The rows of ``docs`` that are drawn, with its columns, whatever their names.

    Rows equal in doc_id and text are kept or dropped together. Null doc_ids and
    texts are drawn like others; an empty table gives no rows.
    """
    model = fit(docs, labels, max_labelled)
    last = ranked(docs, model).where("keep").agg(F.max_by(F.struct("gumbel_key", "row_hash"), "rank")).first()[0]  # one row
    if last is None:
        return docs.limit(0)
    weight, row = temp_names(docs, "log_weight", "row_hash")
    hashed = docs.withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    key = gumbel_key(F.col(weight), F.col(row))
    drawn = (key > last["gumbel_key"]) | ((key == last["gumbel_key"]) & (F.col(row) <= last["row_hash"]))
    return with_log_weights(hashed, model, weight).where(drawn).select(*columns_of(docs))
