"""Phrase collocations by hierarchical pair naming.

A phrase of k words is the pair of the two phrases of k - 1 words that overlap in it. Its name is a function of the
names of that pair, so tasks agree on names without asking each other, and where a text's (k - 1)-word
phrases are frequent, their names are replaced by those of the pairs. Level by level, the pairs of frequent
names are counted over all texts and the frequent ones stored, with the names of their
two parts: those are pointers to the parts' counts, for the cuts of a phrase, and from a part to
the longer phrases that may subsume it.

Names have 64 bits; a pair is counted under the names of both its parts. Two frequent phrases of one language and
length that share a name would be taken for one: for a million of them the chance is 3e-8. Which names are
frequent is known to the texts' tasks as a map of bits of fixed size; a bit may be set by
another name too, which costs a row but changes no count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import pieces
from .common import checkpointed, join_spread, prefix_sums, release
from .words import parts_of

BREAK = b"\xff"  # no byte of UTF-8
LEAST, LONGEST, FIRST, SUBSUMED, FACTOR = 30, 4, 2000, 80, 2_000_000
#: Bits of the map of frequent names, 8 MB a level.
MAP_BITS = 1 << 26
#: Different words, and positions, that a task gathers before it sends counts.
WORDS, POSITIONS = 1 << 19, 1 << 20
#: Languages whose names a task remembers at a time.
LANGUAGES = 16
LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in runs of bounded size, BREAK between pieces; a run but for the first begins anew where the one before ended."""
    for part in parts_of(text):
        yield part.translate(LOWERED).replace(BREAK, b" " + BREAK + b" ").split()


class Names(dict):
    """Names of a language's words; forgotten when there are many. A name never is 0, which stands for a break."""

    def __init__(self, lang: str, most: int = 1 << 17):
        self.seed, self.most = xxhash.xxh64_intdigest(lang.encode()), most
        self[BREAK] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.most:
            self.clear()
            self[BREAK] = 0
        name = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        return name


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of each pair, 0 where one of its parts is 0."""
    x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (right + np.uint64(0x632BE59BD9B4E019))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.where((left == 0) | (right == 0), np.uint64(0), np.maximum(x, np.uint64(1)))


def lit(names: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """``names``, 0 where the map of frequent names rules one out."""
    at = names & np.uint64(MAP_BITS - 1)
    there = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return names * there.astype(np.uint64)


def with_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word and its occurrences; a row without a word has all occurrences of its lang."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        size = 0
        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for run in tokens(text):
                    own = held.setdefault(lang, Counter())
                    size -= len(own)
                    own.update(run)
                    size += len(own)
                    if size > WORDS:
                        yield from sent(held)
                        size = 0
        yield from sent(held)

    def sent(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in held.items():
            own.pop(BREAK, None)
            if own:
                words, counts = [None, *own], [sum(own.values()), *own.values()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "word", "a"])
        held.clear()

    return with_lang(docs).mapInArrow(count, "lang string, word binary, a long").groupBy("lang", "word").agg(F.sum("a").alias("a"))


def named_words(words: DataFrame) -> DataFrame:
    """``words`` with the name of each."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in set(batch.column("lang").to_pylist())}
            made = [xxhash.xxh64_intdigest(w, seeds[x]) or 1 for x, w in zip(batch.column("lang").to_pylist(), batch.column("word").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(made, np.uint64).view(np.int64))], names=[*batch.schema.names, "name"])

    return words.mapInArrow(name, "lang string, word binary, a long, name long")


def bit_map(frequent: DataFrame) -> np.ndarray:
    """Bits at the places of the frequent names; MAP_BITS / 32 rows at most come to the driver."""
    place = F.col("name").bitwiseAND(F.lit(MAP_BITS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))
    rows = frequent.groupBy(F.floor(place / 32).alias("row")).agg(F.bit_or(bit).alias("bits")).toArrow()
    words = np.zeros(MAP_BITS // 32, "<u4")
    words[rows["row"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return words.view(np.uint8)


def pair_counts(docs: DataFrame, maps: list[Broadcast]) -> DataFrame:
    """Names of the left and the right part, and occurrences, of the phrases of ``len(maps) + 1`` words whose parts are frequent by the maps.

    ``maps`` has a map a level, words first. A name stands for its language too.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, Names] = {}
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for batch in pieces(batches, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if len(names) > LANGUAGES:
                    names.clear()
                known, own = names.setdefault(lang, Names(lang)), held.setdefault(lang, [])
                for run in tokens(text):
                    own.append(np.fromiter(map(known.__getitem__, run), np.uint64, len(run)))
                    size += len(run)
                    if size > POSITIONS:
                        tail = np.concatenate(own)[-len(maps) :]  # phrases may reach across the end of a run
                        yield from sent(held)
                        size = 0
                        own = held.setdefault(lang, [])
                        own.append(np.concatenate([np.zeros(1, np.uint64), tail]))
                own.append(np.zeros(1, np.uint64))
        yield from sent(held)

    def sent(held: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for runs in held.values():
            level = np.concatenate([*runs, np.zeros(1, np.uint64)])
            for bits in maps:
                level = lit(level, bits.value)
                left, right = level[:-1], level[1:]
                level = paired(left, right)
            some = np.flatnonzero(level)
            if len(some):
                _, first, counts = np.unique(level[some], return_index=True, return_counts=True)
                at = some[first]
                columns = [pa.array(left[at].view(np.int64)), pa.array(right[at].view(np.int64)), pa.array(counts, pa.int64())]
                for k in range(0, len(at), 1 << 17):
                    yield pa.RecordBatch.from_arrays([c.slice(k, 1 << 17) for c in columns], names=["left", "right", "a"])
        held.clear()

    found = with_lang(docs).mapInArrow(count, "left long, right long, a long")
    return found.groupBy("left", "right").agg(F.sum("a").alias("a"))


def with_names(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the name of each."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("left", "right"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paired(left, right).view(np.int64))], names=[*batch.schema.names, "name"])

    return pairs.mapInArrow(name, "left long, right long, a long, name long")


def score(a: str, l: str, r: str) -> Column:
    """floor(FACTOR * a / (l + r)) in exact decimals."""
    return F.expr(f"(CAST({a} AS DECIMAL(20,0)) * {FACTOR}) div (CAST({l} AS DECIMAL(20,0)) + CAST({r} AS DECIMAL(20,0)))")


def level(pairs: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """Frequent phrases of ``k`` words with text, and the counts of their first and last 1 to k - 1 words, over those of k - 1.

    ``heads`` and ``tails`` hold counts of the first 1, 2, ... words and of the last 1, 2, ... ones.
    """
    own = ("name", "lang", "phrase", "last_word", "a", "heads", "tails")
    left, right = (below.select(*(F.col(c).alias(f"{side}_{c}") for c in own)) for side in ("l", "r"))
    joined = pairs.join(left, F.col("left") == F.col("l_name")).join(right, (F.col("right") == F.col("r_name")) & (F.col("l_lang") == F.col("r_lang")))
    return joined.select(
        "name",
        F.col("l_lang").alias("lang"),
        "left",
        "right",
        F.concat_ws(" ", "l_phrase", "r_last_word").alias("phrase"),
        F.col("r_last_word").alias("last_word"),
        "a",
        F.concat("l_heads", F.array("l_a")).alias("heads"),
        F.concat("r_tails", F.array("r_a")).alias("tails"),
    ).withColumn("cuts", F.array(*(F.struct(score("a", f"heads[{i - 1}]", f"tails[{k - i - 1}]").alias("score"), F.lit(i).alias("cut"), F.col("heads")[i - 1].alias("l"), F.col("tails")[k - i - 1].alias("r")) for i in range(1, k))))


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a, l, r, score) of the candidates that no longer phrase subsumes, and (lang, n)."""
    spark = docs.sparkSession
    words = checkpointed(word_counts(docs).where((F.col("a") >= least) | F.col("word").isNull()))
    totals = words.where(F.col("word").isNull()).select("lang", F.col("a").alias("n"))
    below = checkpointed(named_words(words.where(F.col("word").isNotNull())).select("name", "lang", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last_word"), "a", F.array().cast("array<bigint>").alias("heads"), F.array().cast("array<bigint>").alias("tails")))
    maps, levels = [], []
    for k in range(2, longest + 1):
        maps.append(spark.sparkContext.broadcast(bit_map(below)))
        pairs = with_names(pair_counts(docs, maps).where(F.col("a") >= least))
        below = checkpointed(level(checkpointed(pairs), below, k))
        levels.append(below)
        del pairs
        release(spark)  # a level's counts are the largest shuffle
    kept = []
    for shorter, longer in zip(levels, [*levels[1:], None]):
        chosen = shorter.withColumn("best", F.array_min(F.transform("cuts", lambda c: F.struct(c["score"], c["cut"], c["l"], c["r"]))))
        if longer is not None:
            # a phrase inside one of two words more is inside one of a word more that is at least as frequent
            covers = longer.select("lang", F.explode(F.array("left", "right")).alias("part"), F.col("a").alias("longer"))
            most = covers.groupBy("lang", "part").agg(F.max("longer").alias("longer")).select(F.col("lang").alias("part_lang"), "part", "longer")
            chosen = chosen.join(most, (F.col("name") == F.col("part")) & (F.col("lang") == F.col("part_lang")), "left")
            chosen = chosen.where(F.col("longer").isNull() | (F.expr(f"CAST(longer AS DECIMAL(20,0)) * 100 < CAST(a AS DECIMAL(20,0)) * {subsumed}")))
        kept.append(chosen.select("lang", "phrase", "a", "best.l", "best.r", F.col("best.score").alias("score")))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, totals


def top_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``first`` phrases of each language.

    A null text is empty, a null lang is ``und`` (with the texts of that name); a text without words adds nothing. Repeated
    rows count each. Long texts are counted whole, in parts. Ties are ordered by a, then phrase (bytes of UTF-8). An empty
    table gives no rows; other columns are not looked at. Ranks come from sums over ranges of the
    order, so no language is sorted in one task.
    """
    found, totals = collocations(docs, least, longest)
    placed = checkpointed(prefix_sums(found, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")], {"ahead": F.lit(1)}))
    starts = placed.groupBy("lang").agg(F.min("ahead").alias("start"))
    known = starts.join(totals, "lang").select(F.col("lang").alias("of_lang"), "start", "n")
    ranked = join_spread(placed, known, "lang", "of_lang").withColumn("rank", F.col("ahead") - F.col("start") + 1)
    return ranked.where(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), lists AS MATERIALIZED (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
  FROM lists, (VALUES (1), (2), (3), (4)) t(k)
), counts AS MATERIALIZED (
  SELECT lang, k, g, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.k, c.g, c.a, unnest(range(1, c.k)) AS cut FROM counts c WHERE c.k > 1
), scored AS (
  SELECT u.lang, u.k, u.g, u.a, u.cut, l.a AS l, r.a AS r, (2000000::HUGEINT * u.a // (l.a + r.a)::HUGEINT)::BIGINT AS score
  FROM cuts u JOIN counts l ON l.lang = u.lang AND l.g = u.g[1:u.cut] JOIN counts r ON r.lang = u.lang AND r.g = u.g[u.cut + 1:u.k]
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1
), inside AS (
  SELECT lang, a AS longer, g[i:i + m - 1] AS g FROM counts, (VALUES (2), (3)) s(m), (VALUES (1), (2), (3)) t(i) WHERE m < k AND i + m - 1 <= k
), kept AS (
  SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.longer >= 80 * b.a)
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
       array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM kept b JOIN totals t ON b.lang = t.lang
QUALIFY rank <= 2000
"""
