"""Python data sources of tensor files: .npy arrays, headerless .dyn rows, and linked tensor files."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_PARTITION = 1 << 18
ROWS_PER_BATCH = 1 << 13
#: Fixed values of the tensor file format: its magic number and version.
MAGIC, VERSION = 0x4E564500, (0, 2)
_HEAD, _ENTRY = struct.Struct("<III"), struct.Struct("<QQQQ")
_FLOATS = {"<f4": pa.float32(), "<f8": pa.float64(), "<i4": pa.int32(), "<i8": pa.int64()}


def npy_layout(path: str) -> tuple[np.dtype, tuple[int, ...], int]:
    """(dtype, shape, data offset) of a .npy file; raises ValueError for types or sizes it can't have."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if not read:
            raise ValueError(f"{path}: npy version {version} is not supported")
        shape, fortran, dtype = read(f)
        offset = f.tell()
    if dtype.str not in _FLOATS or fortran and len(shape) > 1:
        raise ValueError(f"{path}: {dtype.str}{' in Fortran order' * fortran} is not supported")
    if os.path.getsize(path) != offset + dtype.itemsize * int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"{path}: the size does not fit the header")
    return dtype, shape, offset


class Rows(InputPartition):
    def __init__(self, begin: int, end: int):
        super().__init__(begin)
        self.begin, self.end = begin, end


class _Reader(DataSourceReader):
    """Fixed-width rows of a file, split by row ranges."""

    def __init__(self, path: str, dtype: np.dtype, width: int, rows: int, offset: int):
        self.path, self.dtype, self.width, self.rows, self.offset = path, dtype, width, rows, offset

    def partitions(self) -> list[Rows]:
        return [Rows(a, min(self.rows, a + ROWS_PER_PARTITION)) for a in range(0, self.rows, ROWS_PER_PARTITION)] or [Rows(0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        kind = _FLOATS[self.dtype.str]
        for a in range(part.begin, part.end, ROWS_PER_BATCH):
            n = min(part.end, a + ROWS_PER_BATCH) - a
            flat = np.fromfile(self.path, self.dtype, n * self.width, offset=self.offset + a * self.width * self.dtype.itemsize)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, n * self.width + 1, self.width), pa.int32()), pa.array(flat, kind))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), values], ["row", "vec"])


_SQL = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "long"}


class NpySource(DataSource):
    """format('npy').load(path): (row long, vec array); one-dimensional arrays have vectors of length 1."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return f"row long, vec array<{_SQL[npy_layout(self.options['path'])[0].str]}>"

    def reader(self, schema) -> DataSourceReader:
        dtype, shape, offset = npy_layout(self.options["path"])
        return _Reader(self.options["path"], dtype, int(np.prod(shape[1:], dtype=np.int64)), shape[0] if shape else 0, offset)


class DynSource(DataSource):
    """format('dyn').option('dtype', '<f4').option('width', n).load(path): headerless rows."""

    @classmethod
    def name(cls) -> str:
        return "dyn"

    def schema(self) -> str:
        return f"row long, vec array<{_SQL[self.options.get('dtype', '<f4')]}>"

    def reader(self, schema) -> DataSourceReader:
        path, dtype, width = self.options["path"], np.dtype(self.options.get("dtype", "<f4")), int(self.options["width"])
        rows, rest = divmod(os.path.getsize(path), width * dtype.itemsize)
        if rest:
            raise ValueError(f"{path}: not a whole number of rows")
        return _Reader(path, dtype, width, rows, 0)


def tensor_entries(path: str) -> dict[int, tuple[int, int, int, int]]:
    """name -> (rows, columns, element size, data offset) of a tensor file, following its links."""
    found, size = {}, os.path.getsize(path)
    with open(path, "rb") as f:
        head = f.read(_HEAD.size)
        if len(head) < _HEAD.size or _HEAD.unpack(head) != (MAGIC, *VERSION):
            raise ValueError(f"{path}: not a tensor file of version {VERSION[0]}.{VERSION[1]}")
        at = _HEAD.size
        while at < size:
            f.seek(at)
            entry = f.read(_ENTRY.size)
            if len(entry) < _ENTRY.size:
                raise ValueError(f"{path}: a table entry is cut off")
            packed, name, following, length = _ENTRY.unpack(entry)
            columns, element, rows = packed & 0xFFFF, packed >> 16 & 0xF, packed >> 20
            if rows * columns * element != length or following <= at or at + _ENTRY.size + length > size:
                raise ValueError(f"{path}: a table entry is damaged")
            found.setdefault(name, (rows, columns, element, at + _ENTRY.size))
            at = following
    return found


def write_tensors(path: str, tensors: dict[int, np.ndarray]) -> None:
    """Write matrices under numeric names; on the driver, for exchange with other programs."""
    with open(path, "wb") as f:
        f.write(_HEAD.pack(MAGIC, *VERSION))
        for name, t in tensors.items():
            if t.ndim != 2 or t.shape[1] >= 1 << 16 or t.shape[0] >= 1 << 44 or t.itemsize >= 16:
                raise ValueError("a tensor is a matrix of under 2**16 columns and 2**44 rows")
            f.write(_ENTRY.pack(t.shape[1] | t.itemsize << 16 | t.shape[0] << 20, name, f.tell() + _ENTRY.size + t.nbytes, t.nbytes))
            f.write(np.ascontiguousarray(t).tobytes())


class TensorSource(DataSource):
    """format('tensorfile').option('tensor', name)[.option('dtype', '<f4')].load(path)."""

    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        return f"row long, vec array<{_SQL[self.options.get('dtype', '<f4')]}>"

    def reader(self, schema) -> DataSourceReader:
        path, name, dtype = self.options["path"], int(self.options["tensor"]), np.dtype(self.options.get("dtype", "<f4"))
        entries = tensor_entries(path)
        if name not in entries:
            raise ValueError(f"{path}: no tensor {name}")
        rows, columns, element, offset = entries[name]
        if element != dtype.itemsize:
            raise ValueError(f"{path}: elements of {element} bytes are not {dtype.str}")
        return _Reader(path, dtype, columns, rows, offset)


def register(spark: SparkSession) -> SparkSession:
    for source in (NpySource, DynSource, TensorSource):
        spark.dataSource.register(source)
    return spark


def import_pairs(keys: DataFrame, values: DataFrame) -> DataFrame:
    """(pos, key, vec) from the row-numbered frames of a key file and a value file of equal length.

    A row that only one of them has is an error when the result is read.
    """
    both = keys.select("row", keys["vec"][0].cast("long").alias("key"), F.lit(True).alias("__k")).join(values.select("row", "vec", F.lit(True).alias("__v")), "row", "full")
    unequal = F.raise_error(F.concat(F.lit("the key and value files differ in length at row "), F.col("row").cast("string")))
    return both.select(F.when(F.col("__k") & F.col("__v"), F.col("row")).otherwise(unequal).alias("pos"), "key", "vec")


def from_batches(spark: SparkSession, batches: Iterator[tuple[np.ndarray, np.ndarray]], first: int = 0) -> Iterator[DataFrame]:
    """(pos, key, vec) frames from an iterator of (keys, rows) arrays, one frame per batch; pos runs on over the batches."""
    at = first
    for keys, rows in batches:
        if rows.ndim != 2 or len(keys) != len(rows):
            raise ValueError("a batch is as many keys as rows")
        n, width = rows.shape
        vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))
        yield spark.createDataFrame(pa.table({"pos": np.arange(at, at + n), "key": np.asarray(keys, np.int64), "vec": vec}))
        at += n
