"""Token id files with a minimal perfect hash index.

A shard is two files. ``shard-NNNNN.ids`` holds nothing but the ids of its
documents, one after another, as little-endian unsigned integers of ``width``
bytes. ``shard-NNNNN.idx`` says where the ids of each document key lie:

    header   12 unsigned 64-bit integers: magic, version, width, entries, entries
             without a key, their ids, keys, levels, words of all levels, cuts, 2 unused
    sizes    levels x uint64: bits of each level
    words    the levels' bits as uint64, each level from a word of its own
    ranks    words x uint32: set bits before each word
    slots    keys x (uint32 fingerprint, uint32 entries, uint64 first id, uint64 ids)
    cuts     cuts x uint64: first id of each entry that is not the first of its key

Level l maps a key to a bit by the hash of seed l; a bit is set if one key alone
of those that reached the level falls on it, and the others go on to the next
level. The rank of a key's bit among all set bits is its slot: a minimal perfect
hash. A lookup touches one bit a level (1.6 on average) and one slot, whatever the
number of documents. Keys are not stored: one that the shard does not hold is
turned away by the fingerprint, but for one in 2 ** 32 that agree by chance.
"""

from __future__ import annotations

import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import Rows, pieces
from .bpe import encoder
from .common import checkpointed, ensure_checkpoint_dir, remove, shuffle_partitions

MAGIC, VERSION, HEADER = 0x3158444944494B54, 2, 12
SLOT = np.dtype([("fingerprint", "<u4"), ("entries", "<u4"), ("start", "<u8"), ("ids", "<u8")])
GAMMA = 1.5
FINGERPRINT_SEED = 0xF1
MANIFEST = "shard int, path string, entries long, ids long, least long, most long, nulls long"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key for each seed."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys, level) % np.uint64(size)).astype(np.int64)


@dataclass
class PerfectHash:
    """Maps each of its keys to another number from 0 to their count - 1."""

    sizes: np.ndarray
    words: np.ndarray
    ranks: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct int64."""
        sizes, words, left = [], [], keys.astype(np.int64).view(np.uint64)
        while len(left):
            size = max(64, int(len(left) * GAMMA))
            at = places(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
            bits[:size] = alone
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        joined = np.concatenate(words) if words else np.zeros(0, "<u8")
        counts = np.bitwise_count(joined).astype(np.int64)
        return cls(np.array(sizes, "<u8"), joined, (np.cumsum(counts) - counts).astype("<u4"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some of the keys that it was not built from."""
        found, base = np.full(len(keys), -1, dtype=np.int64), 0
        rest, left = np.arange(len(keys)), keys.astype(np.int64).view(np.uint64)
        for level, size in enumerate(self.sizes.tolist()):
            at = places(left, level, size)
            word, bit = base + at // 64, (at % 64).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            found[rest[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            rest, left = rest[~hit], left[~hit]
            base += -(-size // 64)
        return found


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.astype(np.int64).view(np.uint64), FINGERPRINT_SEED) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, nulls: int, offsets: np.ndarray, width: int) -> bytes:
    """``keys``: doc_id of each entry in file order, ascending behind ``nulls`` entries without one; ``offsets``: first id of each, then the end."""
    known, starts = keys[nulls:], offsets.astype(np.int64)
    is_first = np.r_[True, known[1:] != known[:-1]] if len(known) else np.zeros(0, bool)
    first = np.flatnonzero(is_first) + nulls
    distinct, after = keys[first], np.r_[first[1:], len(keys)] if len(first) else first
    hashed = PerfectHash.build(distinct)
    slots = np.zeros(len(distinct), SLOT)
    at = hashed.slots(distinct)
    slots["fingerprint"][at], slots["entries"][at] = fingerprints(distinct), after - first
    slots["start"][at], slots["ids"][at] = starts[first], starts[after] - starts[first]
    cuts = starts[:-1][np.r_[np.arange(nulls) > 0, ~is_first]]
    header = np.zeros(HEADER, "<u8")
    header[:10] = MAGIC, VERSION, width, len(keys), nulls, starts[nulls], len(distinct), len(hashed.sizes), len(hashed.words), len(cuts)
    return b"".join(x.tobytes() for x in (header, hashed.sizes, hashed.words, hashed.ranks, slots, cuts.astype("<u8")))


class Shard:
    """A shard opened for reading."""

    def __init__(self, path: str):
        self.fs, self.place = pyarrow.fs.FileSystem.from_uri(path)
        with self.fs.open_input_file(f"{self.place}.idx") as file:
            data = file.read()
        header = np.frombuffer(data, "<u8", HEADER).astype(np.int64)
        if header[0] != MAGIC or header[1] != VERSION:
            raise ValueError(f"{path}.idx is no index of version {VERSION}")
        _, _, self.width, self.entries, self.nulls, self.null_ids, keys, levels, words, cuts = header[:10].tolist()
        at = 8 * HEADER

        def take(kind, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.hashed = PerfectHash(take("<u8", levels), take("<u8", words), take("<u4", words))
        self.slots, self.cuts = take(SLOT, keys), take("<u8", cuts).astype(np.int64)
        self.file = self.fs.open_input_file(f"{self.place}.ids")

    def close(self) -> None:
        self.file.close()

    def read(self, start: int, ids: int) -> np.ndarray:
        """``ids`` ids from the one at ``start`` on."""
        return np.frombuffer(self.file.read_at(ids * self.width, start * self.width), f"<u{self.width}")

    def find(self, doc_ids: np.ndarray) -> np.ndarray:
        """The slot of each doc_id, or -1: through the perfect hash and the fingerprint, in constant time each."""
        slots = self.hashed.slots(doc_ids)
        some = np.flatnonzero((slots >= 0) & (slots < len(self.slots)))
        wrong = self.slots["fingerprint"][slots[some]] != fingerprints(doc_ids[some])
        slots[some[wrong]] = -1
        return slots

    def entries_of(self, start: int, ids: int, entries: int) -> list[tuple[int, int]]:
        """(first id, ids) of each of the ``entries`` that lie in ``ids`` ids from ``start`` on."""
        if entries == 1:
            return [(start, ids)]
        k = int(np.searchsorted(self.cuts, start, "right"))
        bounds = [start, *self.cuts[k : k + entries - 1].tolist(), start + ids]
        return [(a, b - a) for a, b in zip(bounds, bounds[1:])]

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all entries of a doc_id."""
        slot = int(self.find(np.array([doc_id], np.int64))[0])
        if slot < 0:
            return []
        _, entries, start, ids = self.slots[slot].tolist()
        return [self.read(*e) for e in self.entries_of(start, ids, entries)]

    def get_many(self, doc_ids: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of all entries of sorted distinct ``doc_ids``, each looked up; a missing one raises.

        Lookups that lie next to each other in the file are read together, up to ``most`` ids at once.
        """
        slots = self.find(doc_ids)
        if (slots < 0).any():
            raise KeyError(f"{self.place}.idx does not find doc_id {doc_ids[slots < 0][0]}")
        held, known = self.slots[slots], doc_ids.tolist()
        yield from self.run([None] * bool(self.nulls), [0] * bool(self.nulls), [self.null_ids] * bool(self.nulls), [self.nulls] * bool(self.nulls), most)
        yield from self.run(known, held["start"].tolist(), held["ids"].tolist(), held["entries"].tolist(), most)

    def run(self, keys: list, starts: list[int], ids: list[int], entries: list[int], most: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        parts = [(k, *e) for k, start, n, m in zip(keys, starts, ids, entries) for e in self.entries_of(start, n, m)]
        at = 0
        while at < len(parts):
            end, low = at + 1, parts[at][1]
            while end < len(parts) and parts[end][1] == parts[end - 1][1] + parts[end - 1][2] and parts[end][1] + parts[end][2] - low <= most:
                end += 1
            data = self.read(low, parts[end - 1][1] + parts[end - 1][2] - low)
            for key, start, n in parts[at:end]:
                yield key, start, data[start - low : start - low + n]
            at = end


class Keyed:
    """Access to single keys of a shard without its index in memory: for a key a word and a rank a level and one slot are read, and the ids.

    Of a key with several entries the cuts are searched by halves. Beside the header nothing is kept, so a shard of any size
    opens at once; ``Shard`` serves many keys better.
    """

    def __init__(self, path: str):
        fs, place = pyarrow.fs.FileSystem.from_uri(path)
        self.index, self.ids = fs.open_input_file(f"{place}.idx"), fs.open_input_file(f"{place}.ids")
        header = self.numbers(0, HEADER, "<u8").astype(np.int64)
        if header[0] != MAGIC or header[1] != VERSION:
            raise ValueError(f"{path}.idx is no index of version {VERSION}")
        _, _, self.width, _, _, _, self.keys, levels, words, self.n_cuts = header[:10].tolist()
        self.sizes = self.numbers(8 * HEADER, levels, "<u8").tolist()
        self.words = 8 * (HEADER + levels)
        self.ranks = self.words + 8 * words
        self.slots = self.ranks + 4 * words
        self.cuts = self.slots + self.keys * SLOT.itemsize

    def numbers(self, at: int, n: int, kind) -> np.ndarray:
        return np.frombuffer(self.index.read_at(n * np.dtype(kind).itemsize, at), kind)

    def close(self) -> None:
        self.index.close()
        self.ids.close()

    def slot(self, doc_id: int):
        """The slot of a doc_id, or None."""
        key, base = np.array([doc_id], np.int64), 0
        for level, size in enumerate(self.sizes):
            at = int(places(key.view(np.uint64), level, size)[0])
            word, bit = base + at // 64, at % 64
            held = int(self.numbers(self.words + 8 * word, 1, "<u8")[0])
            if held >> bit & 1:
                rank = int(self.numbers(self.ranks + 4 * word, 1, "<u4")[0]) + (held & ((1 << bit) - 1)).bit_count()
                found = self.numbers(self.slots + rank * SLOT.itemsize, 1, SLOT)[0]
                return found if found["fingerprint"] == fingerprints(key)[0] else None
            base += -(-size // 64)
        return None

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all entries of a doc_id; none if it has no entry."""
        found = self.slot(doc_id)
        if found is None:
            return []
        start, count, entries = int(found["start"]), int(found["ids"]), int(found["entries"])
        low, high = 0, self.n_cuts if entries > 1 else 0
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if int(self.numbers(self.cuts + 8 * middle, 1, "<u8")[0]) > start else (middle + 1, high)
        bounds = [start, *(self.numbers(self.cuts + 8 * low, entries - 1, "<u8").tolist() if entries > 1 else []), start + count]
        data = np.frombuffer(self.ids.read_at(count * self.width, start * self.width), f"<u{self.width}")
        return [data[a - start : b - start] for a, b in zip(bounds, bounds[1:])]


def whole(path: str, name: str, write) -> None:
    """A file that is either whole or not there: a task that is run again puts the same file in its place."""
    fs, place = pyarrow.fs.FileSystem.from_uri(path)
    fs.create_dir(place, recursive=True)
    part = f"{place}/.{name}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, f"{place}/{name}")


def uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith(("file:/", "/")) and not path.startswith("file://") else path


def width_of(vocabulary: str, end_id: int, width: int | None) -> int:
    """Bytes of an id: 2 if all ids of the vocabulary and ``end_id`` fit, else 4; a given ``width`` must hold them."""
    largest = max(encoder(vocabulary).library.get_vocab_size() - 1, end_id)
    least = 2 if largest < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < least):
        raise ValueError(f"ids up to {largest} do not fit in {width} bytes")
    return width or least


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, width: int | None = None) -> DataFrame:
    """Writes the ids of all documents below ``path`` in ascending order of doc_id; returns the stored manifest.

    Ids are those of the library for the whole text (null: empty), then
    ``end_id``. Rows without a doc_id come first, rows with the same doc_id stand
    together in the order of their texts' hash, then of their places in the input, and may go over into the next
    shard, so neither a doc_id nor a row that is often repeated is a hot spot. An empty table writes no shard; other
    columns are not looked at. The ranges of the shards come from the keys alone; texts are encoded where they
    are read, and only ids are shuffled. The manifest has a row a shard
    and is stored, so it and the files agree whatever is run again later; a task
    that is run again writes the same file.
    """
    spark, base, n = docs.sparkSession, uri(path), shuffle_partitions(docs.sparkSession)
    size = width_of(vocabulary, end_id, width)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("place"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    ranges = keyed.select("doc_id", "h", "place").repartitionByRange(n, *order).groupBy(F.spark_partition_id().alias("part"))
    firsts = ranges.agg(F.min(F.struct("doc_id", "h", "place")).alias("first")).select("first.*").collect()  # a row a partition
    bounds = sorted((r.doc_id is not None, r.doc_id or 0, r.h, r.place) for r in firsts)[1:]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        for batch in pieces(batches, "text"):
            doc_ids, hashes, places = (batch.column(c).to_pylist() for c in ("doc_id", "h", "place"))
            shard = [bisect_right(bounds, (d is not None, d or 0, h, p)) for d, h, p in zip(doc_ids, hashes, places)]
            ids = [np.frombuffer(own.ids(x) + end, "<u4").astype(f"<u{size}").tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns[:3], pa.array(ids, pa.binary())], names=["shard", "doc_id", "h", "place", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        keys, offsets, nulls = array("q"), array("Q", [0]), 0

        def payload(out) -> None:
            nonlocal nulls
            for batch in batches:
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                    held = ids.as_buffer()
                    out.write(held)
                    nulls += doc_id is None
                    keys.append(doc_id or 0)
                    offsets.append(offsets[-1] + held.size // size)

        name = f"shard-{shard:05d}"
        whole(base, f"{name}.ids", payload)
        whole(base, f"{name}.idx", lambda out: out.write(index_bytes(np.frombuffer(keys, np.int64) if keys else np.zeros(0, np.int64), nulls, np.frombuffer(offsets, np.uint64), size)))
        known = keys[nulls:]
        if keys:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{base}/{name}"], "entries": [len(keys)], "ids": [offsets[-1]], "least": pa.array([known[0] if known else None], pa.int64()), "most": pa.array([known[-1] if known else None], pa.int64()), "nulls": [nulls]})

    dealt = keyed.mapInArrow(encode, "shard int, doc_id long, h long, place long, ids binary").repartitionById(n, "shard").sortWithinPartitions(*order)
    return checkpointed(dealt.select("doc_id", "ids").mapInArrow(write, MANIFEST))


READ = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("start", pa.int64()), ("ids", pa.binary())])


def read_token_files(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """One row for each entry of the doc_ids in ``keys`` (column doc_id; each once or more often): doc_id, shard,
    start (ids of all documents before it) and its ids as little-endian unsigned 32-bit integers.

    Each doc_id is looked up in the shards whose range it lies in, by the perfect hash and its fingerprint, and its ids
    are read from the place that its slot names; one that is not found there raises. Entries without a doc_id come
    with every read. An empty manifest gives no rows.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # a row a shard
    shards = manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0))).orderBy("shard").select("shard", "path", "base", "least", "most").collect()
    least, most = (np.array([r[c] for r in shards if r.least is not None], np.int64) for c in ("least", "most"))
    numbers = np.array([r.shard for r in shards if r.least is not None], np.int32)
    places = {r.shard: (r.path, r.base) for r in shards}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A doc_id may lie in several shards that follow one another."""
        for batch in batches:
            ids = np.unique(batch.column("doc_id").drop_null().to_numpy())
            low, high = np.searchsorted(most, ids), np.searchsorted(least, ids, "right")
            many = np.maximum(high - low, 0)
            at = np.repeat(low - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum()) if len(ids) else low
            yield pa.RecordBatch.from_pydict({"shard": pa.array(numbers[at], pa.int32()), "doc_id": pa.array(np.repeat(ids, many), pa.int64())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, asked = Rows(READ), {}
        shard = TaskContext.get().partitionId()
        if shard in places:
            asked = [np.zeros(0, np.int64), *(batch.column("doc_id").to_numpy() for batch in batches)]
            path, base = places[shard]
            opened = Shard(path)
            for doc_id, start, ids in opened.get_many(np.unique(np.concatenate(asked))):
                held = ids.astype("<u4").tobytes()
                rows.add((doc_id, shard, base + start, held), len(held))
                if rows.full:
                    yield rows.take()
            opened.close()
        yield rows.take()

    wanted = keys.select(F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(deal, "shard int, doc_id long")
    n = max(shuffle_partitions(manifest.sparkSession), *(r.shard + 1 for r in shards), 1)
    dealt = wanted.repartitionById(n, "shard").select("doc_id")
    return dealt.mapInArrow(read, "doc_id long, shard int, start long, ids binary")


def lookup(manifest: DataFrame, doc_id: int) -> list[np.ndarray]:
    """The ids of each entry of a doc_id, read from the one or few shards that may hold it; none where it has no entry. Entries without a doc_id are not found so."""
    paths = [r.path for r in manifest.where((F.col("least") <= doc_id) & (F.col("most") >= doc_id)).orderBy("shard").select("path").collect()]
    out = []
    for path in paths:
        shard = Keyed(path)
        out += shard.get(doc_id)
        shard.close()
    return out


def token_file_digests(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids to files in the shared folder, looks every doc_id up in them and returns doc_id, start, n_tokens and ids_crc32.

    The files are removed once the result, a short row a document, is stored. Raises if not all entries are read.
    """
    spark = docs.sparkSession
    path = f"{uri(ensure_checkpoint_dir(spark)).rstrip('/')}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(docs, path, vocabulary, end_id)
    got = read_token_files(manifest, docs.select("doc_id"))
    out = checkpointed(got.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "shard"))
    remove(spark, path)
    written = manifest.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]  # one row
    if written != out.count():
        raise ValueError("the index does not find all that was written")
    return out
