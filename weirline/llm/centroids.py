"""Centroid clustering of whole-number vectors: Lloyd rounds whose nearest centroids are found through Ptolemaic pivot bounds.

For a vector v, a centroid c and a pair of pivots p, q Ptolemy's inequality gives
d(v, c) d(p, q) >= |d(v, p) d(c, q) - d(v, q) d(c, p)|. The pivots stay fixed, so a
vector's distances to them are worked out once and stored beside it; a round only works
out those of its few centroids. Centroids whose bound is not beyond the distance to a
first guess are checked exactly in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import Scratch

DIM, CLUSTERS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Pivots; every two of them make a pair.
PIVOTS = 6
#: Relative slack of a bound; its own rounding errors stay below 1e-14.
EPS = 1e-12
#: Components reach to this magnitude at most, so that squared distances fit a long at any dimension up to 256.
LARGEST = 1 << 26


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of a to rows of b, or to the one row b."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


@dataclass(frozen=True)
class Pivots:
    """Fixed pivots and the pairs of them that lie apart."""

    at: np.ndarray

    @classmethod
    def spread(cls, points: np.ndarray, n: int = PIVOTS) -> Pivots:
        """n of the points, each the farthest from those before it."""
        chosen = [0] if len(points) else []
        while len(chosen) < min(n, len(points)):
            far = np.min([squared(points, points[i]) for i in chosen], axis=0)
            if not far.max():
                break
            chosen.append(int(far.argmax()))
        return cls(points[chosen])

    def distances(self, v: np.ndarray) -> np.ndarray:
        """Exact squared distances of each row to each pivot."""
        return np.stack([squared(v, p) for p in self.at], 1) if len(self.at) else np.zeros((len(v), 0), np.int64)

    def bounds(self, dv: np.ndarray, dc: np.ndarray) -> np.ndarray:
        """No more than the distance of each vector to each centroid, from their distances to the pivots; rounded down."""
        own, out = np.sqrt(self.distances(self.at)), np.zeros((len(dv), len(dc)))
        for p in range(len(self.at)):
            for q in range(p):
                x, y = dv[:, p, None] * dc[None, :, q], dv[:, q, None] * dc[None, :, p]
                np.maximum(out, (np.abs(x - y) - EPS * (x + y)) * ((1 - EPS) / own[p, q]), out=out)
        return out


def nearest(v: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact checks made); the smaller number wins a tie.

    The first guess is the centroid nearest by distances to the pivots.
    """
    dv, dc = np.sqrt(to_pivots), np.sqrt(pivots.distances(centroids))
    apart = np.zeros((len(v), len(centroids)))
    for p in range(dv.shape[1]):
        apart += (dv[:, p, None] - dc[None, :, p]) ** 2
    best = apart.argmin(1)
    dist = squared(v, centroids[best])
    left = pivots.bounds(dv, dc) <= (np.sqrt(dist) * (1 + EPS))[:, None]
    left[np.arange(len(v)), best] = False
    for c in range(len(centroids)):
        rows = np.flatnonzero(left[:, c])
        d = squared(v[rows], centroids[c])
        win = (d < dist[rows]) | ((d == dist[rows]) & (c < best[rows]))
        best[rows[win]], dist[rows[win]] = c, d[win]
    return best, dist, len(v) + int(left.sum())


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, dim: int, scale: int) -> DataFrame:
    """(id, v): vectors of exactly dim components as floor(scale * x), each x as a double.

    Vectors with a null, non-finite or too large component (floor(scale * x) beyond
    LARGEST, where a squared distance need not fit a long) are left out.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / scale)
    kept = rows.where((F.size("x") == dim) & F.forall("x", lambda x: F.coalesce(fits(x), F.lit(False))))
    return kept.select("id", F.transform("x", lambda x: F.floor(x * float(scale)).cast("int")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def with_pivots(rows: DataFrame, pivots: Pivots, dim: int) -> DataFrame:
    """(id, v, far): each vector with its squared distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = pivots.distances(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(far), pa.list_(pa.int64()))], names=["id", "v", "far"])

    return rows.mapInArrow(run, "id long, v array<int>, far array<long>")


def sums(table: DataFrame, centroids: np.ndarray, pivots: Pivots) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact componentwise sums of every centroid that has some.

    Each task adds up its own rows; what is exchanged and returned is bounded by centroids x components.
    """
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            v, far = _matrix(b.column(0), dim), _matrix(b.column(1), len(pivots.at))
            best = nearest(v, far, centroids, pivots)[0]
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, v)
        c, j = np.divmod(np.arange(k * (dim + 1)), dim + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(j), pa.array(np.column_stack((total, n)).ravel())], names=["c", "j", "s"])

    parts = table.select("v", "far").mapInArrow(run, "c long, j long, s long")
    added = parts.groupBy("c", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # centroids x (components + 1) rows
    grid = {(r.c, r.j): int(r.s) for r in added}
    return {c: (grid[c, dim], [grid[c, j] for j in range(dim)]) for c in range(k) if grid.get((c, dim))}


def assigned(table: DataFrame, centroids: np.ndarray, pivots: Pivots) -> DataFrame:
    """(id, cluster, distance): the nearest centroid of each vector and the squared distance to it."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, dist, _ = nearest(_matrix(b.column(1), dim), _matrix(b.column(2), len(pivots.at)), centroids, pivots)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best.astype(np.int32)), pa.array(dist)], names=["id", "cluster", "distance"])

    return table.mapInArrow(run, "id long, cluster int, distance long")


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hex SHA-256 of "seed:id", in that order; equal ids by components, null ids last."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    return np.array([r.v for r in rows.orderBy(by.asc_nulls_last(), "v").limit(k).collect()], np.int64)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = DIM, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every vector that can be used, final centroids).

    Each round moves every centroid that has vectors to floor(sum / count) of each
    component; others stay. Vectors of another length, with a null, NaN, infinite or too
    large component (see whole_vectors) take no part and have no row. Equal vectors and
    repeated ids are rows of their own. Ties go to the smaller number. Fewer than k
    vectors: as many centroids; none: an empty result. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    rows = whole_vectors(vectors, id_col, vec_col, dim, scale)
    at = first_centroids(rows, k, seed)
    if not len(at):
        return scratch.table(rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))), []
    pivots = Pivots.spread(at)
    table = scratch.table(with_pivots(rows, pivots, dim))
    for _ in range(rounds):
        for c, (n, total) in sums(table, at, pivots).items():
            at[c] = [s // n for s in total]
    return scratch.last(assigned(table, at, pivots)), at.tolist()


def report(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """found with each cluster's and the whole inertia (sums of squared distances; null beyond a long) and the SHA-256 of its centroid's components."""
    per = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row a centroid
    fit = lambda n: n if n < 1 << 63 else None
    rows = [(c, fit(per.get(c, 0)), fit(sum(per.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    facts = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
