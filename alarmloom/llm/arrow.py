"""Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that the values of ``column`` in a piece take about ``most_bytes`` at most, or it has one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and total + size > most_bytes:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


class Rows:
    """Gathers rows of ``schema`` and hands them out in batches of about ``most_bytes``."""

    def __init__(self, schema: pa.Schema, most_bytes: int = 4 << 20):
        self.schema, self.most_bytes = schema, most_bytes
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.held += size + 64

    @property
    def full(self) -> bool:
        return self.held >= self.most_bytes

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, self.schema)], schema=self.schema)
