"""Vector bin packing of token pieces into sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import Rows, pieces
from .bpe import encoder


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 2048
    segments: int = 10
    loss_tokens: int = 2016


@dataclass(frozen=True)
class Piece:
    """A run of a document's ids."""

    doc_id: int | None
    start: int
    ids: bytes  # little-endian unsigned 32-bit integers
    loss: int
    doc_tokens: int

    @property
    def length(self) -> int:
        return len(self.ids) // 4


def cut(doc_id: int | None, ids: bytes, loss: int, limits: Limits) -> list[Piece]:
    """Cuts a document's ids so that each piece is within the limits; its last ``loss`` ids bear loss."""
    n, made, start = len(ids) // 4, [], 0
    unmasked = n - min(loss, n)
    while start < n:
        end = min(n, start + limits.tokens, max(start, unmasked) + limits.loss_tokens)
        made.append(Piece(doc_id, start, ids[4 * start : 4 * end], max(0, end - max(start, unmasked)), n))
        start = end
    return made


class Window:
    """Pieces that wait for a place. Sequences are filled one at a time by the dot-product rule."""

    def __init__(self, limits: Limits, size: int):
        self.limits, self.size = np.array([limits.tokens, limits.segments, limits.loss_tokens], dtype=np.int64), size
        self.vectors = np.zeros((2 * size, 3), dtype=np.int64)
        self.held: list[Piece | None] = [None] * (2 * size)
        self.free = list(range(2 * size - 1, -1, -1))
        self.count = 0

    def add(self, piece: Piece) -> None:
        k = self.free.pop()
        self.held[k], self.vectors[k] = piece, (piece.length, 1, piece.loss)
        self.count += 1

    def fill(self) -> tuple[list[Piece], str]:
        """The pieces of one sequence: each time the one that fits and whose share of the limits points most along
        what is left. And what closed it: the first limit that each waiting piece breaks, or that none waits."""
        left, chosen = self.limits.copy(), []
        while self.count:
            here = self.vectors[:, 1] > 0
            over = self.vectors > left
            fits = here & ~over.any(axis=1)
            if not fits.any():
                broken = over[here]
                return chosen, next((name for name, by in zip(LIMITS, broken.T) if by.all()), "mixed")
            along = self.vectors @ (left / self.limits**2)
            k = int(np.argmax(np.where(fits, along, -1.0)))
            chosen.append(self.held[k])
            left -= self.vectors[k]
            self.held[k], self.vectors[k] = None, 0
            self.free.append(k)
            self.count -= 1
        return chosen, "end"


#: What a sequence may be closed by; "mixed" where waiting pieces break different limits, "end" where none waits.
LIMITS = ("tokens", "segments", "loss_tokens")
OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("input_ids", pa.binary()), ("loss_tokens", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("closed_by", pa.string())])


def first_line(text: Column) -> Column:
    """What stands before the first line break, as the prompt of a document; no text without one has a prompt."""
    return F.when(F.contains(text, F.lit("\n")), F.substring_index(text, "\n", 1)).otherwise(F.lit(""))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, limits: Limits = Limits(), window: int = 512, loss_column: str | None = None, prompt: Callable[[Column], Column] | None = None) -> DataFrame:
    """Packs all documents into sequences within ``limits``; one row a piece, with its ids and what closed its sequence.

    A document's ids are those of the library for the whole text (null: empty),
    then ``end_id``, so an empty text is one id long. Documents longer than a
    sequence are cut, whatever their length. The last ``loss_column`` ids of a document bear loss (null:
    none); or else all but as many as ``prompt`` of the text has ids; or else all of them. Pieces of full length make sequences of their own;
    the others wait in a window of ``window`` to twice as many pieces until
    sequences are filled from it. Each task packs what it reads and ends with at
    most a few sequences that are not full, so nothing is shuffled and no group of
    rows matters; sequence_id holds the task's number in its upper half. Every
    id lies in exactly one piece. Repeated rows are packed each for itself; a null doc_id stays null; an
    empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce("text", F.lit(""))
    loss = F.col(loss_column).cast("long") if loss_column else F.lit(None).cast("long")
    asked = prompt(text) if prompt else F.lit("")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), loss.alias("loss"), asked.alias("prompt"))
    counted = loss_column is not None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = encoder(vocabulary), int(end_id).to_bytes(4, "little")
        waiting, rows = Window(limits, window), Rows(OUT)
        next_id = TaskContext.get().partitionId() << 32

        def emit(sequence: list[Piece], closed_by: str) -> None:
            nonlocal next_id
            offset = 0
            for p in sequence:
                rows.add((p.doc_id, p.start, p.length, p.ids, p.loss, p.doc_tokens, next_id, offset, closed_by), len(p.ids))
                offset += p.length
            next_id += 1

        for batch in pieces(batches, "text"):
            for doc_id, text, bear, unmasked in zip(*(c.to_pylist() for c in batch.columns)):
                ids = own.ids(text) + end
                n = len(ids) // 4
                for piece in cut(doc_id, ids, max(0, bear or 0) if counted else n - len(own.ids(unmasked)) // 4, limits):
                    if piece.length == limits.tokens:
                        emit([piece], LIMITS[0])
                    else:
                        waiting.add(piece)
                        while waiting.count >= 2 * window:
                            emit(*waiting.fill())
                    if rows.full:
                        yield rows.take()
        while waiting.count:
            emit(*waiting.fill())
            if rows.full:
                yield rows.take()
        yield rows.take()

    return source.mapInArrow(pack, "doc_id long, start long, length long, input_ids binary, loss_tokens long, doc_tokens long, sequence_id long, offset long, closed_by string")


def packed_digests(packed: DataFrame) -> DataFrame:
    """The pieces of ``pack_documents`` with a checksum in place of their ids: a row a piece, none for an empty table."""
    return packed.select("doc_id", "start", "length", F.crc32("input_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "loss_tokens", "closed_by")
