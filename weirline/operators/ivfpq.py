"""Approximate nearest neighbours: an inverted file of cells with product-quantised codes behind an orthogonal rotation.

The parts of an index are named as in "OPQ64,IVF1024,PQ64". Training is Lloyd rounds over a
sample that stays in Spark: tasks add up their rows by key, others merge the sums of
their keys, and the driver only holds the model. Every row is indexed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirline.functions import vectors
from weirline.operators.topk import slices, top

#: Rows of the training sample for each cell, and at least; the model is fitted to these, by hash of id.
ROWS_A_CELL, ROWS_AT_LEAST = 64, 65_536
CODES = 256
LLOYD, TURNS = 8, 4
#: Vectors or codes of one side that a task holds at a time.
BLOCK = 4096
#: Candidates by codes for each neighbour asked for that are compared exactly.
RERANK = 16
#: Most cells a search probes where it is not told, and their largest share.
PROBES, SHARE = 128, 1 / 8
#: Bytes of partial sums that a task holds before it hands them on, and of centroids that are shipped whole.
HELD, SHIPPED = 64 << 20, 2 << 30

# The index of a corpus of more than so many rows.
INDEX_TYPES = (
    (500_000_000, "OPQ64,IVF262144,PQ64"),
    (100_000_000, "OPQ64,IVF131072,PQ64"),
    (10_000_000, "OPQ64,IVF65536,PQ64"),
    (4_000_000, "OPQ64,IVF32768,PQ64"),
    (700_000, "OPQ64,IVF16384,PQ64"),
    (250_000, "OPQ64,IVF8192,PQ64"),
    (160_000, "OPQ64,IVF4096,PQ64"),
    (80_000, "OPQ64,IVF2048,PQ64"),
    (10_000, "OPQ64,IVF1024,PQ64"),
)


def index_type(rows: int) -> str:
    """Name of the index for a corpus: exact search for few rows, more cells for more."""
    return next((name for least, name in INDEX_TYPES if rows > least), "Flat")


def n_cells(kind: str) -> int:
    """Cells of a named index; 1 for exact search."""
    m = re.search(r"IVF(\d+)", kind)
    return int(m[1]) if m else 1


def n_parts(kind: str, dim: int) -> int:
    """Sub-vectors of a named index: as many as it names, or the most that divide the dimension."""
    most = int(re.search(r"PQ(\d+)$", kind)[1])
    return next(p for p in range(min(most, dim), 0, -1) if dim % p == 0)


@dataclass(frozen=True)
class Index:
    """rotation (dim, dim) orthogonal, cells (n, dim) and codebooks (parts, CODES, dim / parts) of what a cell leaves, all in the rotated space."""

    rotation: np.ndarray
    cells: np.ndarray
    codebooks: np.ndarray

    def nearest_cells(self, y: np.ndarray, n: int = 1) -> np.ndarray:
        """Numbers of the n cells closest to each rotated vector, best first."""
        half = (self.cells**2).sum(1) / 2
        out = []
        for a in range(0, len(y), 1024):
            far = half - y[a : a + 1024] @ self.cells.T
            if n == 1:
                out.append(far.argmin(1)[:, None])
                continue
            near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < far.shape[1] else np.tile(np.arange(far.shape[1]), (len(far), 1))
            out.append(np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.empty((0, n), np.int64)

    def encode(self, rest: np.ndarray) -> np.ndarray:
        """A code of each part of what is left of vectors after their cells."""
        return closest(rest, self.codebooks).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([book[codes[:, m]] for m, book in enumerate(self.codebooks)], 1)

    def tables(self, y: np.ndarray) -> np.ndarray:
        """(queries, parts, CODES): products of each query's parts with all codewords."""
        parts, _, width = self.codebooks.shape
        return np.einsum("qmw,mcw->qmc", y.reshape(len(y), parts, width), self.codebooks)


def closest(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The closest codeword of each part."""
    parts, _, width = books.shape
    out = np.empty((len(x), parts), np.int64)
    for m, book in enumerate(books):
        out[:, m] = ((book**2).sum(1) / 2 - x[:, m * width : (m + 1) * width] @ book.T).argmin(1)
    return out


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def added(keys: np.ndarray, n: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and vectors added up by key."""
    order = np.argsort(keys, kind="stable")
    keys, n, x = keys[order], n[order], x[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(n, at), np.add.reduceat(x, at)


def vector_sums(rows: DataFrame, f: Callable, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, counts, sums) over f(vectors, model) -> (keys, counts, vectors) of every batch of rows (vec).

    A task adds up what it holds and hands it on when it is large, so that a key has few
    rows a task; they are merged as they stream in, and what comes back is a row a key.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    names = ["key", "n", "x"]

    def batch(part) -> pa.RecordBatch:
        keys, n, x = part
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(list(x), pa.list_(pa.float64()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                part = f(matrix(b.column(0)), shipped.value)
                held = added(*(np.concatenate(p) for p in zip(held, part))) if held else added(*part)
                if held[2].nbytes > HELD:
                    yield batch(held)
                    held = None
        if held:
            yield batch(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if b.num_rows:
                part = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
                held = added(*(np.concatenate(p) for p in zip(held, part))) if held else added(*part)
        if held:
            yield batch(held)

    schema = "key long, n long, x array<double>"
    out = rows.select("vec").mapInArrow(run, schema).repartition("key").mapInArrow(merge, schema).toArrow()
    return added(out.column("key").to_numpy(), out.column("n").to_numpy(), matrix(out.column("x").combine_chunks()))


def lloyd(sample: DataFrame, start: np.ndarray, rotation: np.ndarray, rounds: int = LLOYD) -> np.ndarray:
    """Centroids of rotated vectors; one that loses all its rows takes half of the largest cell's."""

    def part(x, model):
        index, turn = model
        at = index.nearest_cells(y := x @ turn)[:, 0]
        return at, np.ones(len(y)), y

    c = start.copy()
    for _ in range(rounds):
        keys, n, sums = vector_sums(sample, part, (Index(rotation, c, np.empty((0, CODES, 0))), rotation))
        size = np.zeros(len(c))
        size[keys], c[keys] = n, sums / n[:, None]
        for empty in np.flatnonzero(size == 0):
            full = int(size.argmax())
            sign = 1 + 1e-3 * (-1.0) ** np.arange(c.shape[1])
            c[empty], c[full] = c[full] * sign, c[full] * (2 - sign)
            size[empty] = size[full] = size[full] / 2
    return c


def moved(books: np.ndarray, sums: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Codebooks at the means of what chose them; unused codewords stay."""
    keys, n, x = sums
    out = books.copy()
    out.reshape(-1, books.shape[2])[keys] = x / n[:, None]
    return out


def by_codeword(y: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, codes, width = books.shape
    return (closest(y, books) + np.arange(parts) * codes).ravel(), np.ones(len(y) * parts), y.reshape(-1, width)


def first_books(y: np.ndarray, parts: int) -> np.ndarray:
    """Codewords to begin with: the parts of CODES rows, fewer rows repeated with a little noise."""
    r = np.random.default_rng(0)
    x = y[np.resize(np.arange(len(y)), CODES)] + r.normal(0, 1e-6, (CODES, y.shape[1]))
    return np.ascontiguousarray(x.reshape(CODES, parts, -1).transpose(1, 0, 2))


def balanced(sample: DataFrame, dim: int, parts: int) -> np.ndarray:
    """Principal axes dealt to the parts so that the products of their variances are near equal."""

    def part(x, _):
        return np.arange(dim + 1), np.full(dim + 1, len(x)), np.vstack((x.T @ x, x.sum(0)))

    _, n, s = vector_sums(sample, part, None)
    mean = s[dim] / n[dim]
    values, axes = np.linalg.eigh(s[:dim] / n[dim] - np.outer(mean, mean))
    load, dealt = np.zeros(parts), [[] for _ in range(parts)]
    for k in np.argsort(-values, kind="stable"):
        free = [m for m in range(parts) if len(dealt[m]) < dim // parts]
        m = min(free, key=lambda i: load[i])
        dealt[m].append(k)
        load[m] += np.log(max(values[k], 1e-12) * len(values) / max(values.sum(), 1e-12) + 1)
    return axes[:, [k for d in dealt for k in d]]


def learned_rotation(sample: DataFrame, few: np.ndarray, parts: int, turns: int = TURNS) -> np.ndarray:
    """An orthogonal rotation that lessens the error of product codes: codebooks and rotation (Procrustes) in turn."""
    dim = few.shape[1]
    turn = balanced(sample, dim, parts)
    books = first_books(few @ turn, parts)

    def codes(x, model):
        return by_codeword(x @ model[0], model[1])

    def against(x, model):
        y = x @ model[0]
        near = np.concatenate([book[c] for book, c in zip(model[1], closest(y, model[1]).T)], 1)
        return np.arange(dim), np.full(dim, len(x)), x.T @ near

    for _ in range(turns):
        books = moved(books, vector_sums(sample, codes, (turn, books)))
        u, _, v = np.linalg.svd(vector_sums(sample, against, (turn, books))[2])
        turn = u @ v
    return turn


def train(base: DataFrame, kind: str, rounds: int = LLOYD) -> Index:
    """The named index for base (id, vec), fitted to about ROWS_A_CELL rows a cell (ROWS_AT_LEAST at least) by hash of id; all rows where there are fewer.

    Never more cells than rows of the sample.
    """
    rows = base.where("vec is not null").select("id", "vec")
    wanted, n = max(ROWS_AT_LEAST, ROWS_A_CELL * n_cells(kind)), rows.count()
    if n > wanted:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 40)) < int((1 << 40) * (wanted / n)))
    sample = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = sample.orderBy(F.xxhash64("id", F.lit(8)), "id").limit(max(n_cells(kind), CODES)).select("vec").toArrow()  # rows of the model's own size
        few = matrix(first.column(0).combine_chunks())
        dim = few.shape[1]
        if few[: n_cells(kind)].nbytes > SHIPPED:
            raise ValueError(f"{kind} over {dim} dimensions is larger than {SHIPPED} bytes")
        parts = n_parts(kind, dim)
        turn = learned_rotation(sample, few, parts) if kind.startswith("OPQ") else np.eye(dim)
        cells = lloyd(sample, few[: n_cells(kind)] @ turn, turn, rounds)
        index = Index(turn, cells, np.empty((0, CODES, 0)))
        rest = few @ turn
        books = first_books(rest - cells[index.nearest_cells(rest)[:, 0]], parts)

        def codes(x, model):
            own, books = model
            y = x @ own.rotation
            return by_codeword(y - own.cells[own.nearest_cells(y)[:, 0]], books)

        for _ in range(rounds):
            books = moved(books, vector_sums(sample, codes, (index, books)))
        return Index(turn, cells, books)
    finally:
        sample.unpersist()


def populate(base: DataFrame, index: Index) -> DataFrame:
    """(id, cell, code) of every row of base (id, vec); indexes over one model merge by union."""
    shipped = base.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            if b.num_rows:
                y = matrix(b.column(1)) @ own.rotation
                at = own.nearest_cells(y)[:, 0]
                codes = own.encode(y - own.cells[at])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])

    return base.where("vec is not null").select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "id long, cell int, code binary")


def probed(queries: DataFrame, index: Index, nprobe: int) -> DataFrame:
    """(q_id, y, cell): each query, rotated, with each of its nprobe closest cells."""
    shipped = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for b in batches:
            if b.num_rows:
                y = matrix(b.column(1)) @ own.rotation
                cells = own.nearest_cells(y, nprobe).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(y), pa.list_(pa.float64())), pa.array(list(cells), pa.list_(pa.int32()))], names=["q_id", "y", "cells"])

    each = queries.where("vec is not null").select(F.col("id").cast("long").alias("id"), "vec").mapInArrow(run, "q_id long, y array<double>, cells array<int>")
    return each.select("q_id", "y", F.explode("cells").alias("cell"))


def candidates(queries: DataFrame, codes: DataFrame, index: Index, n: int, nprobe: int, block: int = BLOCK) -> DataFrame:
    """(q_id, b_id): the n best of each query by codes among the rows of its nprobe closest cells.

    A cell's queries meet its codes in tiles of bounded size, whatever their numbers.
    """
    shipped = queries.sparkSession.sparkContext.broadcast(index)
    asked = probed(queries, index, nprobe)
    parts = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
    tiles = F.broadcast(parts(codes, "nb").join(parts(asked, "nq"), "cell"))  # a row a cell
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = asked.join(tiles, "cell").select("q_id", "y", "cell", own("q_id", "nq").alias("i"), every("nb").alias("j"))
    b = codes.join(tiles, "cell").select("id", "code", "cell", every("nq").alias("i"), own("id", "nb").alias("j"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q_id": pa.array([], pa.int64()), "b_id": pa.array([], pa.int64()), "est": pa.array([], pa.float64())})
        model = shipped.value
        b_id = right.column("id").to_numpy()
        order = np.argsort(b_id, kind="stable")
        b_id = b_id[order]
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(b_id), -1)[order]
        cell = model.cells[left.column("cell")[0].as_py()]
        q_id, out = left.column("q_id").to_numpy(), []
        y = matrix(left.column("y").combine_chunks())
        near = model.decode(code) + cell  # the rows that the codes stand for
        for at in slices(len(y), len(b_id)):
            est = y[at] @ near.T
            w, i = top(est, n)
            out.append((q_id[at][w], b_id[i], est[w, i]))
        return pa.table(dict(zip(("q_id", "b_id", "est"), (np.concatenate(x) for x in zip(*out)))))

    near = q.groupBy("cell", "i", "j").cogroup(b.groupBy("cell", "i", "j")).applyInArrow(best, "q_id long, b_id long, est double")
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("est"), "b_id"))
    return near.withColumn("r", rank).where(F.col("r") <= n).select("q_id", "b_id")


def search(queries: DataFrame, base: DataFrame, codes: DataFrame, index: Index, k: int, nprobe: int | None = None, rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """(q_id, b_id, rank, sim): of each query's k * rerank candidates by codes the k with the highest exact inner products, ties by id.

    codes: populate(base, index), or a union of such over parts of base.
    """
    nprobe = nprobe or max(1, min(PROBES, int(len(index.cells) * SHARE)))
    pairs = candidates(queries, codes, index, k * rerank, min(nprobe, len(index.cells)), block)
    b = base.select(F.col("id").alias("b_id"), F.col("vec").alias("b_vec"))
    q = queries.select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec"))
    exact = pairs.join(b, "b_id").join(q, "q_id").select("q_id", "b_id", vectors.dot(F.col("q_vec"), F.col("b_vec")).alias("sim"))
    w = Window.partitionBy("q_id").orderBy(F.desc(F.round("sim", 9)), "b_id")
    return exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("q_id", "b_id", "sim", "rank")


def save(spark: SparkSession, index: Index, path: str) -> None:
    """The model as a Parquet table of named rows of numbers."""
    parts = {"rotation": index.rotation, "cells": index.cells, "codebooks": index.codebooks.reshape(-1, index.codebooks.shape[2])}
    rows = [(name, k, x.tolist()) for name, m in parts.items() for k, x in enumerate(m)]
    spark.createDataFrame(rows, "part string, row int, x array<double>").write.parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    t = spark.read.parquet(path).orderBy("part", "row").toArrow()
    part = t.column("part").to_numpy(zero_copy_only=False)
    own = {name: np.array([x for x, p in zip(t.column("x").to_pylist(), part) if p == name]) for name in ("rotation", "cells", "codebooks")}
    width = own["codebooks"].shape[1]
    return Index(own["rotation"], own["cells"], own["codebooks"].reshape(-1, CODES, width))
