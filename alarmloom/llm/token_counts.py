"""Token counts of whole texts; huge texts are encoded in overlapping chunks that are spliced where both agree.

A chunk's tokens near its ends may differ from those of the whole text. A lone
space or line break between two other characters is a boundary that no token and
no word of the vocabularies handled here spans, whatever stands further away, so
tokens before it depend on nothing after it, and the other way round. Two chunks
are spliced at such a boundary in their overlap if between it and another one
both give the same tokens at the same places. If there are no two boundaries, or
they disagree, the overlap is doubled, and after that the chunk.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .arrow import pieces
from .bpe import Encoder, encoder
from .common import column, numbered, temp_names

BOUNDARY = re.compile(r"(?<=\S)[ \n](?=\S)").finditer


class Chunk:
    """Tokens of ``text[start:end]``: their ids and where they start and end in the whole text."""

    def __init__(self, own: Encoder, text: str, start: int, end: int):
        got = own.library.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, got.ids
        self.places = [(a + start, b + start) for a, b in got.offsets]
        self.starts = [a for a, _ in self.places]

    def split(self, at: int) -> int | None:
        """Number of tokens before ``at``, or None if one spans it."""
        k = bisect_left(self.starts, at)
        return k if not k or self.places[k - 1][1] <= at else None

    def between(self, a: int, b: int) -> list | None:
        i, j = self.split(a), self.split(b)
        return None if i is None or j is None else list(zip(self.ids[i:j], self.places[i:j]))


def splice(text: str, left: Chunk, right: Chunk) -> int | None:
    """A boundary in the overlap before which ``left`` and from which on ``right`` has the tokens of the whole text."""
    found = [m.start() for m in BOUNDARY(text, right.start + 1, left.end - 1)]
    if len(found) < 2:
        return None
    first, last = found[0], found[-1]
    agreed = left.between(first, last)
    return first if agreed and agreed == right.between(first, last) else None


def spliced_ids(own: Encoder, text: str, chunk: int, overlap: int) -> tuple[list[int], int, int]:
    """Ids of ``text``, the number of chunks encoded and how often an overlap or a chunk was widened."""
    ids: list[int] = []
    left, since, chunks, widened = Chunk(own, text, 0, min(chunk, len(text))), 0, 1, 0
    size = chunk
    while left.end < len(text):
        wide = overlap
        while True:
            start = max(left.end - wide, left.start)
            right = Chunk(own, text, start, min(left.end + size, len(text)))
            chunks += 1
            if (at := splice(text, left, right)) is not None:
                break
            widened += 1
            if start > left.start:
                wide *= 2
            else:  # the overlap is the whole chunk: a longer one takes its place
                size *= 2
                left = Chunk(own, text, left.start, min(left.start + size, len(text)))
                chunks += 1
                if left.end == len(text):
                    return ids + left.ids[since_index(left, since):], chunks, widened
        ids += left.ids[since_index(left, since) : left.split(at)]
        left, since, size = right, at, chunk
    return ids + left.ids[since_index(left, since):], chunks, widened


def since_index(chunk: Chunk, since: int) -> int:
    return bisect_left(chunk.starts, since) if since else 0


def count_text(own: Encoder, text: str, chunk: int, overlap: int) -> tuple[int, int, int]:
    """Tokens, chunks and widenings of a text. A vocabulary of another kind has no known boundaries: one chunk."""
    if len(text) <= chunk or not own.kind:
        return len(own.ids(text)) // 4, 1, 0
    ids, chunks, widened = spliced_ids(own, text, chunk, overlap)
    return len(ids), chunks, widened


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, chunk: int = 8_192, overlap: int = 512, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` of each document with n_bytes, n_tokens, over_limit, n_chunks and n_widened.

    The count is that of the library for the whole text, without special tokens
    added. A null text counts as empty: no bytes, no tokens; an empty table gives no rows; other columns are not looked at. Rows are handled
    one by one where they are read, so repeated rows and keys do not matter; no
    text is held but the one in work, and the ids of no more than two chunks.
    """
    (body,) = temp_names(docs, "body")
    source, fields = numbered(docs.select(*map(column, keys), F.coalesce("text", F.lit("")).alias(body)), body)
    added = StructType.fromDDL("n_bytes long, n_tokens long, n_chunks long, n_widened long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in pieces(batches, body):
            texts = batch.column(body)
            got = [count_text(own, x, chunk, overlap) for x in texts.to_pylist()]
            columns = batch.columns[: len(keys)]
            columns += [pc.binary_length(texts).cast(pa.int64())]
            columns += [pa.array([x[i] for x in got], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[: len(keys)], *added.names])

    counted = source.mapInArrow(count, StructType([*fields[:-1], *added])).toDF(*keys, *added.names)
    return counted.select(*map(column, keys), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks", "n_widened")
