"""Rank statistics of two columns in n log n: ordered pairs, Kendall's tau-b, Spearman; no pair of rows or values is ever formed."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.operators import sampling

#: Values of a digit of the second column's ranks; a pass over the rows settles one digit.
DIGITS = 256
CHUNK = 4096


def _added(n: np.ndarray, greater: np.ndarray) -> pa.Table:
    return pa.table({"s": [float((n.astype(np.longdouble) * greater).sum())]})


def _across(t: pa.Table) -> pa.Table:
    """Pairs of one prefix whose first column lies in different ranges: (x range, digit, n) cells, at most ranges x DIGITS."""
    xr, at = np.unique(t.column("xr").to_numpy(), return_inverse=True)
    grid = np.zeros((len(xr), DIGITS))
    np.add.at(grid, (at, t.column("d").to_numpy()), t.column("n").to_numpy())
    before = np.cumsum(grid, 0) - grid
    up_to = np.cumsum(before, 1)
    return _added(grid, up_to[:, -1:] - up_to)


def _inside(t: pa.Table) -> pa.Table:
    """Pairs of one prefix inside one range of the first column."""
    x, d, n = (t.column(c).to_numpy() for c in ("x", "d", "n"))
    order = np.argsort(x, kind="stable")
    x, d, n = x[order], d[order], n[order]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    starts = np.flatnonzero(new)
    cuts = starts[np.unique(np.searchsorted(starts, np.arange(0, len(x), CHUNK), "right") - 1)].tolist() + [len(x)]
    seen, greater = np.zeros(DIGITS), np.zeros(len(x))
    for a, b in zip(cuts, cuts[1:]):
        rows = np.zeros((b - a + 1, DIGITS))
        rows[0] = seen
        rows[np.arange(1, b - a + 1), d[a:b]] = n[a:b]
        total = np.cumsum(rows, 0)
        first = np.maximum.accumulate(np.where(new[a:b], np.arange(b - a), 0))
        up_to = np.cumsum(total[first], 1)  # what came before the row's own x
        greater[a:b] = up_to[:, -1] - up_to[np.arange(b - a), d[a:b]]
        seen = total[-1]
    return _added(n, greater)


def discordant(counts: DataFrame, buckets: int | None = None) -> float:
    """Pairs of counts (x, y, n; each pair of values once) with x lower and y higher than the other's.

    y is ranked and the ranks are read digit by digit: two rows differ first in one digit,
    and there the higher digit must come with the lower x. Rows of one prefix of digits are
    counted by ranges of x (of some 50,000 rows, where buckets does not say how many), then
    inside ranges, so that no task holds more than a range.
    """
    buckets = buckets or max(4, min(4096, counts.count() // 50_000))
    ranks = sampling.positions(counts.select("y").distinct(), "y").select("y", "pos").persist()
    try:
        levels = max(1, math.ceil(math.log(max(ranks.count(), 2), DIGITS)))
        rows = counts.join(ranks, "y").select("x", "pos", "n")
        total = 0.0
        for level in range(levels):
            unit = DIGITS**level
            g = rows.groupBy(F.floor(F.col("pos") / (unit * DIGITS)).alias("p"), "x", (F.floor(F.col("pos") / unit) % DIGITS).cast("int").alias("d")).agg(F.sum("n").alias("n"))
            g = sampling.ranges(g, "x", "xr", buckets).persist()
            try:
                cells = g.groupBy("p", "xr", "d").agg(F.sum("n").alias("n")).groupBy("p").applyInArrow(_across, "s double")
                total += sum(df.agg(F.sum("s")).first()[0] or 0.0 for df in (cells, g.groupBy("p", "xr").applyInArrow(_inside, "s double")))
            finally:
                g.unpersist()
        return total
    finally:
        ranks.unpersist()


@dataclass(frozen=True)
class PairCounts:
    """Pairs of rows in all, in and against one order, and tied in x, in y, in both; exact up to 2^53."""

    pairs: float
    concordant: float
    discordant: float
    x_tied: float
    y_tied: float
    both_tied: float

    def tau_b(self) -> float | None:
        of = math.sqrt((self.pairs - self.x_tied) * (self.pairs - self.y_tied))
        return (self.concordant - self.discordant) / of if of else None

    def ordered_share(self) -> float | None:
        """Share of the pairs with different y whose x is in the same order; a tie in x counts half."""
        of = self.pairs - self.y_tied
        return (self.concordant + 0.5 * (self.x_tied - self.both_tied)) / of if of else None


def counted(df: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n): the different values of the rows that have both."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    return rows.groupBy("x", "y").agg(F.count("*").alias("n"))


def pair_counts(counts: DataFrame) -> PairCounts:
    two = lambda df: float(df.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] or 0.0)
    by = lambda *keys: counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    pairs, xt, yt, both = two(by()), two(by("x")), two(by("y")), two(counts)
    against = discordant(counts)
    return PairCounts(pairs, pairs - xt - yt + both - against, against, xt, yt, both)


def average_ranks(counts: DataFrame, column: str) -> DataFrame:
    """(column, rank): the mean of the places, from 1, that the rows of a value take."""
    each = counts.groupBy(column).agg(F.sum("n").alias("n")).withColumn("_all", F.lit(0))
    return sampling.offsets(each, "n", column, "_all", "_before").select(column, (F.col("_before") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(counts: DataFrame) -> DataFrame:
    """(spearman): correlation of average ranks."""
    ranked = counts.join(average_ranks(counts, "x").toDF("x", "rx"), "x").join(average_ranks(counts, "y").toDF("y", "ry"), "y")
    m = counts.agg(((F.sum("n") + 1) / 2).alias("m"))
    c = ranked.crossJoin(F.broadcast(m)).select("n", (F.col("rx") - F.col("m")).alias("a"), (F.col("ry") - F.col("m")).alias("b"))  # one row
    s = lambda v: F.sum(F.col("n") * v)
    return c.agg((s(F.col("a") * F.col("b")) / F.sqrt(s(F.col("a") * F.col("a")) * s(F.col("b") * F.col("b")))).alias("spearman"))
