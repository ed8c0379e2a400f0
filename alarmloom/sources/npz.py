"""NumPy's npz files as a data source: an array a column, rows along the first axis.

Files are read in ranges of rows, each a task of its own that seeks to its rows in every array. A task writes files of
bounded size below a staging folder; they are moved to their place when all tasks are done, and deleted if one fails.
Rows may be wide, so ranges and files are bounded by their cells too, and Python's objects are made of a piece of rows at a time.
Arrays hold numbers or text of one width; nothing is pickled.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructType

#: Rows of a file, and of a range that one task reads.
FILE_ROWS, RANGE_ROWS = 65_536, 16_384
#: Cells of a file, of a range, and of a piece that is made into Python's objects.
FILE_CELLS, RANGE_CELLS, PIECE_CELLS = 4_000_000, 4_000_000, 250_000
MANIFEST = "_files.json"
KINDS = {IntegerType: np.int32, LongType: np.int64, DoubleType: np.float64, StringType: np.str_}


def kind_of(field) -> tuple[type, bool]:
    """NumPy's type of a column and whether a row of it is an array."""
    inner = field.dataType.elementType if isinstance(field.dataType, ArrayType) else field.dataType
    if type(inner) not in KINDS:
        raise ValueError(f"npz files hold numbers, text and arrays of them, not {field.dataType.simpleString()} ({field.name})")
    return KINDS[type(inner)], isinstance(field.dataType, ArrayType)


def as_array(field, values: list) -> np.ndarray:
    kind, nested = kind_of(field)
    if any(v is None or (nested and any(x is None for x in v)) for v in values):
        raise ValueError(f"npz files hold no nulls ({field.name})")
    if nested and len({len(v) for v in values}) > 1:
        raise ValueError(f"rows of {field.name} differ in length; pad them first")
    made = np.array(values, dtype=kind)
    # NumPy drops zeros at the end of text
    if kind is np.str_ and any(x.endswith("\0") for x in made.ravel().tolist()) | any(x.endswith("\0") for v in values for x in (v if nested else [v])):
        raise ValueError(f"text of {field.name} ends in a zero character")
    return made.reshape(len(values), -1) if nested else made


def cells_of(array: pa.Array) -> np.ndarray:
    """Cells of each row of a column."""
    if pa.types.is_list(array.type):
        return array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.ones(len(array), dtype=np.int64)


def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """A batch in slices of at most PIECE_CELLS cells, a row at least, with their cells."""
    ends = np.cumsum(sum((cells_of(c) for c in batch.columns), np.zeros(batch.num_rows, dtype=np.int64)))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_CELLS, "right")))
        yield batch.slice(start, stop - start), int(ends[stop - 1]) - before
        start = stop


def place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class Rows(InputPartition):
    file: str
    start: int
    stop: int


def header(file) -> tuple[tuple[int, ...], np.dtype]:
    version = np.lib.format.read_magic(file)
    shape, fortran, dtype = np.lib.format.read_array_header_1_0(file) if version == (1, 0) else np.lib.format.read_array_header_2_0(file)
    if fortran and len(shape) > 1 or dtype.hasobject:
        raise ValueError("arrays must be in row order and hold no objects")
    return shape, dtype


def rows_of(archive: zipfile.ZipFile, name: str, start: int, stop: int) -> np.ndarray:
    """Rows ``start`` to ``stop`` of an array; only those are read."""
    with archive.open(f"{name}.npy") as file:
        shape, dtype = header(file)
        width = int(np.prod(shape[1:], dtype=np.int64)) * dtype.itemsize
        file.seek(file.tell() + start * width)
        return np.frombuffer(file.read((stop - start) * width), dtype).reshape(stop - start, *shape[1:])


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.schema, self.path = schema, path

    def files(self) -> list[str]:
        """Those of the last commit; of a folder without one all npz files, and a file itself."""
        system, path = place(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        if system.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{path}/{MANIFEST}") as file:
                return [f"{path}/{name}" for name in json.loads(file.read())]
        return sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".npz"))

    def partitions(self) -> list[Rows]:
        system, _ = place(self.path)
        out = []
        for name in self.files():
            with system.open_input_file(name) as file, zipfile.ZipFile(file) as archive:
                shapes = [self.shape(archive, column) for column in self.schema.names]
            n, width = shapes[0][0], sum(int(np.prod(shape[1:], dtype=np.int64)) for shape in shapes)
            step = max(1, min(RANGE_ROWS, RANGE_CELLS // max(1, width)))
            out += [Rows(name, k, min(n, k + step)) for k in range(0, n, step)]
        return out or [Rows("", 0, 0)]

    def shape(self, archive: zipfile.ZipFile, column: str) -> tuple[int, ...]:
        with archive.open(f"{column}.npy") as file:
            return header(file)[0]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition.stop == partition.start:
            return
        system, _ = place(self.path)
        wanted = to_arrow_schema(self.schema)
        with system.open_input_file(partition.file) as file, zipfile.ZipFile(file) as archive:
            columns = [rows_of(archive, f.name, partition.start, partition.stop) for f in self.schema]
        width = sum(int(np.prod(c.shape[1:], dtype=np.int64)) for c in columns)
        step = max(1, PIECE_CELLS // max(1, width))
        for k in range(0, partition.stop - partition.start, step):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + step].tolist(), t.type) for c, t in zip(columns, wanted)], schema=wanted)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class NpzWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, path: str, overwrite: bool):
        for field in schema:
            kind_of(field)
        self.schema, self.path, self.overwrite = schema, path.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = place(self.path)
        system.create_dir(f"{path}/{self.staging}", recursive=True)
        held, rows, cells, names = [], 0, 0, []
        for batch in batches:
            for piece, size in pieces(batch):
                if held and (cells + size > FILE_CELLS or rows + piece.num_rows > FILE_ROWS):
                    names.append(self.store(system, path, held))
                    held, rows, cells = [], 0, 0
                held.append([as_array(f, column.to_pylist()) for f, column in zip(self.schema, piece.columns)])
                rows, cells = rows + piece.num_rows, cells + size
        if held:
            names.append(self.store(system, path, held))
        return Written(names)

    def store(self, system: fs.FileSystem, path: str, held: list[list[np.ndarray]]) -> str:
        arrays = {}
        for i, field in enumerate(self.schema):
            if len({piece[i].shape[1:] for piece in held}) > 1:
                raise ValueError(f"rows of {field.name} differ in length; pad them first")
            arrays[field.name] = np.concatenate([piece[i] for piece in held])
        buffer, name = io.BytesIO(), f"part-{uuid.uuid4().hex}.npz"
        np.savez(buffer, **arrays)
        with system.open_output_stream(f"{path}/{self.staging}/{name}") as file:
            file.write(buffer.getbuffer())
        return name

    def commit(self, messages: list[Written]) -> None:
        """Moves the files of tasks that have ended well, then names them in the manifest, which readers go by."""
        system, path = place(self.path)
        system.create_dir(path, recursive=True)
        names = [n for m in messages if m is not None for n in m.files]
        before = [] if self.overwrite else [f.removeprefix(f"{path}/") for f in NpzReader(self.schema, self.path).files()]
        for name in names:
            system.move(f"{path}/{self.staging}/{name}", f"{path}/{name}")
        with system.open_output_stream(f"{path}/{MANIFEST}.new") as file:
            file.write(json.dumps(sorted(before + names)).encode())
        system.move(f"{path}/{MANIFEST}.new", f"{path}/{MANIFEST}")
        self.clear(system, path)

    def abort(self, messages: list[Written]) -> None:
        self.clear(*place(self.path))

    def clear(self, system: fs.FileSystem, path: str) -> None:
        if system.get_file_info(f"{path}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{path}/{self.staging}")


class NpzDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> StructType:
        raise ValueError("npz files name no types of their columns; give a schema")

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> NpzWriter:
        return NpzWriter(schema, self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpzDataSource)
