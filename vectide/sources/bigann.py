"""Readers of the Big-ANN benchmark files, as a Spark data source: spark.read.format("bigann").load(path).

`.u8bin .i8bin .fbin`: two little-endian uint32 (rows, width), then the values row
by row, to (vec_id, embedding).  `.ibin`: queries and k, then int32 ids and
float32 distances, to (query_id, rank, id).  Rows have a fixed width, so a file is
cut into byte ranges that are read in parallel.  A path is a local file, or a URI of
a store that Arrow can open.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

KINDS = {".u8bin": "u1", ".i8bin": "i1", ".fbin": "<f4"}
WIDEST = 4096
PART_BYTES = 32 << 20


def _opened(path: str) -> pa.NativeFile:
    """A file to read and seek in: a path, or a URI of any store that Arrow knows (file, hdfs, s3, gs)."""
    if "://" in path:
        store, path = pafs.FileSystem.from_uri(path)
    else:
        store = pafs.LocalFileSystem()
    return store.open_input_file(path)


def read_header(path: str) -> tuple[int, int]:
    """Rows and width; an impossible header is an error."""
    with _opened(path) as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path}: no header")
    rows, dims = struct.unpack("<II", head)
    if not 0 < rows < 1 << 31 or not 0 < dims <= WIDEST:
        raise ValueError(f"{path}: {rows} rows of width {dims}")
    return rows, dims


def _kind(path: str) -> str:
    suffix = os.path.splitext(path)[1]
    if suffix not in KINDS and suffix != ".ibin":
        raise ValueError(f"{path}: unknown suffix {suffix!r}")
    return suffix


class _Range(InputPartition):
    def __init__(self, start: int, stop: int):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, part_bytes: int):
        self.path, self.part_bytes = path, part_bytes
        self.suffix = _kind(path)
        if self.suffix == ".ibin":
            with _opened(path) as f:
                head, size = f.read(8), f.size()
            if len(head) < 8:
                raise ValueError(f"{path}: no header")
            self.rows, self.dims = struct.unpack("<II", head)
            if size < 8 + 8 * self.rows * self.dims:
                raise ValueError(f"{path}: shorter than its header says")
            self.size = 4 * self.dims
        else:
            self.rows, self.dims = read_header(path)
            self.size = self.dims * np.dtype(KINDS[self.suffix]).itemsize

    def partitions(self) -> list[_Range]:
        step = max(1, self.part_bytes // max(1, self.size))
        return [_Range(k, min(k + step, self.rows)) for k in range(0, self.rows, step)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as f:
            f.seek(8 + part.start * self.size)
            for at in range(part.start, part.stop, 4096):
                n = min(4096, part.stop - at)
                body = f.read(n * self.size)
                if len(body) < n * self.size:
                    raise EOFError(f"{self.path}: ends within row {at + len(body) // self.size} of {self.rows}")
                yield self._batch(body, at, n)

    def _batch(self, body: bytes, at: int, n: int) -> pa.RecordBatch:
        if self.suffix == ".ibin":
            ids = np.frombuffer(body, dtype="<i4")
            return pa.record_batch([pa.array(np.repeat(np.arange(at, at + n), self.dims), pa.int64()), pa.array(np.tile(np.arange(1, self.dims + 1), n), pa.int64()), pa.array(ids, pa.int32())], names=["query_id", "rank", "id"])
        x = np.frombuffer(body, dtype=KINDS[self.suffix]).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dims, pa.int32()), pa.array(x))
        return pa.record_batch([pa.array(np.arange(at, at + n), pa.int64()), lists], names=["vec_id", "embedding"])


class BigAnn(DataSource):
    """Options: path; part_bytes, the size of a byte range."""

    @classmethod
    def name(cls) -> str:
        return "bigann"

    def schema(self) -> str:
        return "query_id long, rank long, id int" if _kind(self.options["path"]) == ".ibin" else "vec_id long, embedding array<float>"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BigAnn)


def write(path: str, x: np.ndarray) -> None:
    """A benchmark file of these rows, by its suffix; for tests and small sets."""
    with open(path, "wb") as f:
        f.write(struct.pack("<II", *x.shape) + np.ascontiguousarray(x, dtype=KINDS[_kind(path)]).tobytes())


def write_truth(path: str, ids: np.ndarray, distances: np.ndarray | None = None) -> None:
    """Ground truth of queries x k ids, and their distances, as `.ibin`."""
    d = np.zeros(ids.shape) if distances is None else distances
    with open(path, "wb") as f:
        f.write(struct.pack("<II", *ids.shape) + np.ascontiguousarray(ids, dtype="<i4").tobytes() + np.ascontiguousarray(d, dtype="<f4").tobytes())
