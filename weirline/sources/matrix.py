"""Dense matrix files as a Spark data source: byte ranges of .npy files, or of bare rows beside a header file, one range a task."""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

RANGE_BYTES = 128 << 20
BATCH_BYTES = 8 << 20
HEAD_BYTES = 1 << 16
SCHEMA = "file string, row long, embedding array<float>"


@dataclass
class Rows(InputPartition):
    """Rows first to first + n of a file whose numbers begin at byte `start`."""

    file: str
    start: int
    dim: int
    dtype: str
    first: int
    n: int


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def header(data: bytes) -> tuple[int, int, str, int] | None:
    """(rows, columns, dtype, bytes of the header) of the beginning of an .npy file; None for other files."""
    if data[:6] != b"\x93NUMPY":
        return None
    f = io.BytesIO(data)
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, by_column, dtype = read(f)
    if len(shape) != 2 or by_column:
        raise ValueError(f"a matrix of rows is wanted, not one of shape {shape}{' by columns' * by_column}")
    return shape[0], shape[1], dtype.str, f.tell()


class MatrixReader(DataSourceReader):
    def __init__(self, schema, options: dict):
        self.columns = [f.name for f in schema.fields]
        self.path = options["path"]
        self.dim, self.dtype = int(options.get("dim", 0)), options.get("dtype", "<f4")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.first = int(options.get("first", 0))
        self.last = self.first + int(options["rows"]) if "rows" in options else 1 << 62

    def files(self) -> list[tuple[str, int]]:
        system, path = opened(self.path)
        folder, _, name = path.rstrip("/").rpartition("/")
        if any(c in name for c in "*?["):
            found = [i for i in system.get_file_info(pafs.FileSelector(folder)) if i.is_file and fnmatch.fnmatch(i.base_name, name)]
        else:
            one = system.get_file_info(path)
            if one.type == pafs.FileType.NotFound:
                raise FileNotFoundError(self.path)
            found = [i for i in system.get_file_info(pafs.FileSelector(path)) if i.is_file] if one.type == pafs.FileType.Directory else [one]
        return sorted((i.path, i.size) for i in found if not i.base_name.endswith(".hdr"))

    def shape(self, path: str, size: int) -> tuple[int, int, str, int]:
        """(rows, columns, dtype, start) by the file's own header, that of a file beside it (.hdr), or the options."""
        system, _ = opened(self.path)
        with system.open_input_file(path) as f:
            own = header(f.read(min(size, HEAD_BYTES)))
        if own:
            return own
        beside = re.sub(r"\.[^./]*$", "", path) + ".hdr"
        if system.get_file_info(beside).is_file:
            with system.open_input_file(beside) as f:
                n, dim, dtype, _ = header(f.read())
            return n, dim, dtype, 0
        if not self.dim:
            raise ValueError(f"{path} has no header of its own, none beside it, and no dim is given")
        return size // (self.dim * np.dtype(self.dtype).itemsize), self.dim, self.dtype, 0

    def partitions(self) -> list[Rows]:
        out = []
        for path, size in self.files():
            n, dim, dtype, start = self.shape(path, size)
            width = dim * np.dtype(dtype).itemsize
            if start + n * width > size:
                raise ValueError(f"{path} ends before its {n} rows of {width} bytes")
            step = max(1, self.range_bytes // max(1, width))
            first, last = max(0, self.first), min(n, self.last)
            out += [Rows(path, start, dim, dtype, at, min(step, last - at)) for at in range(first, last, step)]
        return out or [Rows("", 0, 1, "<f4", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.n:
            return
        width = part.dim * np.dtype(part.dtype).itemsize
        step = max(1, BATCH_BYTES // max(1, width))
        system, _ = opened(self.path)
        wanted = "embedding" in self.columns
        with system.open_input_file(part.file) if wanted else io.BytesIO() as f:
            for at in range(part.first, part.first + part.n, step):
                n = min(step, part.first + part.n - at)
                cols = {"file": lambda n=n: pa.array([part.file] * n), "row": lambda at=at, n=n: pa.array(np.arange(at, at + n))}
                if wanted:
                    f.seek(part.start + at * width)
                    m = np.frombuffer(f.read(n * width), part.dtype).astype("float32")
                    cols["embedding"] = lambda m=m, n=n: pa.ListArray.from_arrays(pa.array(np.arange(0, n * part.dim + 1, part.dim, dtype=np.int32)), pa.array(m))
                yield pa.RecordBatch.from_arrays([cols[c]() for c in self.columns], names=self.columns)


class BoundedReader(MatrixReader):
    """For sessions with spark.sql.python.filterPushdown.enabled; Spark refuses a reader that takes filters in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on row become the rows that are read."""
        for f in filters:
            if getattr(f, "attribute", None) != ("row",):
                yield f
                continue
            low = {GreaterThan: f.value + 1, GreaterThanOrEqual: f.value, EqualTo: f.value}.get(type(f)) if isinstance(getattr(f, "value", None), int) else None
            high = {LessThan: f.value, LessThanOrEqual: f.value + 1, EqualTo: f.value + 1}.get(type(f)) if isinstance(getattr(f, "value", None), int) else None
            self.first = self.first if low is None else max(self.first, low)
            self.last = self.last if high is None else min(self.last, high)
            if low is None and high is None:
                yield f


class MatrixSource(DataSource):
    """Format "matrix": (file, row, embedding), or some of these by schema().

    Options: rangebytes (bytes a task), pushdown (true where the session lets Python
    sources take filters: bounds on row are then read as ranges), first and rows (rows of each file), dim and dtype
    (of bare files without a header beside them). Paths are files, folders or globs of any
    file system that Arrow opens.
    """

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (BoundedReader if options.get("pushdown") == "true" else MatrixReader)(schema, options)


def read_matrix(spark: SparkSession, path: str, dim: int | None = None, dtype: str = "<f4", range_bytes: int = RANGE_BYTES, first: int = 0, rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """(file, row, embedding) of dense matrix files, or the given columns of it: .npy, or bare rows of numbers; half floats become floats.

    No task reads more than range_bytes (one row at least), whatever a file's size.
    """
    spark.dataSource.register(MatrixSource)
    types = dict(f.split(" ") for f in SCHEMA.split(", "))
    r = spark.read.format("matrix").option("dtype", dtype).option("rangebytes", range_bytes).option("first", first)
    r = r.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    r = r.option("dim", dim) if dim else r
    r = r.option("rows", rows) if rows is not None else r
    r = r.schema(", ".join(f"{c} {types[c]}" for c in columns)) if columns else r
    return r.load(path)
