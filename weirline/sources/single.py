"""One ordered file written by many tasks: sizes first, then each task at its own offset, then a rename."""

from __future__ import annotations

import io
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.operators.rounds import checkpointed

PARTS = 64


def local(path: str) -> str:
    """The path on a file system that driver and executors mount alike; offsets cannot be written to object stores."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: one file by offsets needs a mounted folder that all tasks share")
    return path


def in_parts(df: DataFrame, order: list[str], parts: int) -> DataFrame:
    """df in order, cut into parts that stay as they are: (_part, ...)."""
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return checkpointed(dealt.select(F.spark_partition_id().alias("_part"), "*"))


def part_sizes(placed: DataFrame, encode: Callable[[pa.RecordBatch], list[bytes]]) -> dict[int, tuple[int, list[int]]]:
    """Rows of each part and the bytes of each section that encode() makes of them; a row a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, size = None, 0, None
        for b in batches:
            if b.num_rows:
                part, n = b.column("_part")[0].as_py(), n + b.num_rows
                made = [len(x) for x in encode(b)]
                size = [x + y for x, y in zip(size or [0] * len(made), made)]
        if part is not None:
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [n], "size": [size]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64()), ("size", pa.list_(pa.int64()))]))

    return {r.part: (r.n, list(r["size"])) for r in placed.mapInArrow(run, "part int, n long, size array<long>").collect()}


def write_single(placed: DataFrame, path: str, encode: Callable[[pa.RecordBatch, list[int]], list[bytes]], head: Callable[[int], bytes], tail: Callable[[int, list[int]], bytes] = lambda n, ends: b"", sections: int = 1) -> int:
    """Writes head(rows), the sections of all parts of in_parts(), then tail(rows, ends of the sections) to one file; returns the rows.

    encode(batch, offsets) gives a batch's bytes for each section, to be written from those
    offsets; its sizes do not depend on the offsets. A task that is tried again writes the
    same bytes to the same places. The file has its name only when it is whole; a job that
    fails leaves nothing.
    """
    target = local(path)
    held = f"{target}.{uuid.uuid4().hex}.tmp"
    sizes = part_sizes(placed, lambda b: encode(b, [0] * sections))
    rows = sum(n for n, _ in sizes.values())
    first = head(rows)
    order = sorted(sizes)
    flat = [sizes[p][1][s] for s in range(sections) for p in order]
    starts = list(accumulate(flat, initial=len(first)))
    at = {p: [starts[s * len(order) + k] for s in range(sections)] for k, p in enumerate(order)}
    ends = [starts[(s + 1) * len(order)] for s in range(sections)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, done = None, 0
        with open(held, "r+b") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                place = place or list(at[b.column("_part")[0].as_py()])
                for s, data in enumerate(encode(b, list(place))):
                    f.seek(place[s])
                    f.write(data)
                    place[s] += len(data)
                done += b.num_rows
            f.flush()
            os.fsync(f.fileno())
        yield pa.RecordBatch.from_pydict({"n": [done]})

    try:
        with open(held, "wb") as f:
            f.write(first)
            f.seek(starts[-1])
            f.write(tail(rows, ends))
            f.truncate()
        written = placed.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
        if written != rows:
            raise RuntimeError(f"{written} of {rows} rows written")
        os.replace(held, target)
    except BaseException:
        if os.path.exists(held):
            os.remove(held)
        raise
    return rows


def write_text(df: DataFrame, path: str, order: list[str], text: str = "text", parts: int = PARTS) -> int:
    """Lines in order as one file of UTF-8 lines; a null is an empty line."""

    def encode(b: pa.RecordBatch, _) -> list[bytes]:
        return [b"".join((x or "").encode() + b"\n" for x in b.column(text).to_pylist())]

    return write_single(in_parts(df.select(*dict.fromkeys([*order, text])), order, parts), path, encode, lambda n: b"")


def npy_header(rows: int, dim: int, dtype: str) -> bytes:
    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"descr": np.dtype(dtype).str, "fortran_order": False, "shape": (rows, dim)})
    return f.getvalue()


def write_matrix(df: DataFrame, path: str, order: list[str], vec: str = "embedding", dtype: str = "<f4", header_beside: bool = False, parts: int = PARTS) -> int:
    """Vectors in order as one .npy file (dtype "<f2" for half floats), or bare rows with the header in a file beside it; vectors of other lengths, and null ones, are an error."""
    one = df.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    dim = one[0] if one else 0

    def encode(b: pa.RecordBatch, _) -> list[bytes]:
        col = b.column(vec)
        if col.null_count or any(len(x) != dim for x in col):
            raise ValueError(f"not all vectors have {dim} numbers")
        return [col.flatten().to_numpy(zero_copy_only=False).astype(dtype).tobytes()]

    placed = in_parts(df.select(*dict.fromkeys([*order, vec])), order, parts)
    n = write_single(placed, path, encode, (lambda n: b"") if header_beside else lambda n: npy_header(n, dim, dtype))
    if header_beside:
        with open(f"{os.path.splitext(local(path))[0]}.hdr", "wb") as f:
            f.write(npy_header(n, dim, dtype))
    return n


# Signatures and sizes of the ZIP format.
LOCAL_ENTRY, CENTRAL_ENTRY, END, END_64, LOCATOR_64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
LOCAL_BYTES, WIDE = 30, 0xFFFFFFFF
DATE = (1980 - 1980) << 9 | 1 << 5 | 1


def entry(name: bytes, data: bytes) -> bytes:
    """A stored entry: its header, name and bytes."""
    return LOCAL_ENTRY + struct.pack("<5H3I2H", 20, 0x800, 0, 0, DATE, zlib.crc32(data), len(data), len(data), len(name), 0) + name + data


def directory_entry(name: bytes, data: bytes, at: int) -> bytes:
    """Its line in the central directory; the offset is always in a 64-bit extra field, so that the size does not depend on it."""
    extra = struct.pack("<HHQ", 1, 8, at)
    fixed = struct.pack("<6H3I5H2I", 45, 45, 0x800, 0, 0, DATE, zlib.crc32(data), len(data), len(data), len(name), len(extra), 0, 0, 0, 0, WIDE)
    return CENTRAL_ENTRY + fixed + name + extra


def directory_end(n: int, ends: list[int]) -> bytes:
    """The end of an archive of n entries whose data and directory end at `ends`."""
    start, size = ends[0], ends[1] - ends[0]
    wide = END_64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start) + LOCATOR_64 + struct.pack("<IQI", 0, ends[1], 1)
    return wide + END + struct.pack("<4H2IH", 0, 0, 0xFFFF, 0xFFFF, WIDE, WIDE, 0)


def write_archive(df: DataFrame, path: str, name: str = "name", data: str = "data", parts: int = PARTS) -> DataFrame:
    """One ZIP of stored items (name, data) in order of name; returns the manifest (name, first_byte, length) of the items' bytes in it.

    Tasks write entries and their lines of the central directory at their own offsets.
    An item is at most 2 GB; equal names are an error (merged() drops repeats first).
    """
    own = df.select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(data), F.lit("")).cast("binary").alias("data"))
    twice = own.groupBy("name").agg(F.count("*").alias("n")).where("n > 1 or name is null").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].name!r} is there {twice[0].n} times")
    placed = in_parts(own, ["name"], parts)

    def encode(b: pa.RecordBatch, places: list[int]) -> list[bytes]:
        items, lines, at = [], [], places[0]
        for n, d in zip(b.column("name").to_pylist(), b.column("data").to_pylist()):
            items.append(entry(n.encode(), d))
            lines.append(directory_entry(n.encode(), d, at))
            at += len(items[-1])
        return [b"".join(items), b"".join(lines)]

    write_single(placed, path, encode, lambda n: b"", directory_end, sections=2)
    starts, size = {}, lambda c: LOCAL_BYTES + F.octet_length("name") + F.octet_length(c)
    at = 0
    for r in placed.groupBy("_part").agg(F.sum(size("data").cast("long")).alias("n")).orderBy("_part").collect():  # a row a part
        starts[r._part], at = at, at + r.n

    def manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = None
        for b in batches:
            if b.num_rows:
                here = starts[b.column("_part")[0].as_py()] if here is None else here
                rows = []
                for n, d in zip(b.column("name").to_pylist(), b.column("length").to_pylist()):
                    rows.append((n, here + LOCAL_BYTES + len(n.encode()), d))
                    here = rows[-1][1] + d
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["name", "first_byte", "length"])

    lengths = placed.select("_part", "name", F.octet_length("data").cast("long").alias("length"))
    return lengths.mapInArrow(manifest, "name string, first_byte long, length long")


def read_items(manifest: DataFrame, archive: str) -> DataFrame:
    """(name, data) of a manifest's items, read from the archive by offset and length."""
    path = local(archive)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for b in batches:
                out = []
                for at, n in zip(b.column("first_byte").to_pylist(), b.column("length").to_pylist()):
                    f.seek(at)
                    out.append(f.read(n))
                yield pa.RecordBatch.from_arrays([b.column("name"), pa.array(out, pa.binary())], names=["name", "data"])

    return manifest.select("name", "first_byte", "length").mapInArrow(run, "name string, data binary")


def merged(archives: list[tuple[DataFrame, str]], path: str, parts: int = PARTS) -> DataFrame:
    """One archive of several (manifest, path), each name once, from the first archive that has it; returns its manifest."""
    every = None
    for k, (manifest, archive) in enumerate(archives):
        own = manifest.select("name", "first_byte", "length", F.lit(k).alias("from"))
        every = own if every is None else every.unionByName(own)
    first = every.groupBy("name").agg(F.min(F.struct("from", "first_byte", "length")).alias("x")).select("name", "x.*")
    items = None
    for k, (_, archive) in enumerate(archives):
        own = read_items(first.where(F.col("from") == k), archive)
        items = own if items is None else items.unionByName(own)
    return write_archive(items, path, parts=parts)
