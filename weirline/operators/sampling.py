"""Seeded sampling, temperature sizes and shards by keyed hashes: the same rows on any cluster."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shard_of(key: Column, n: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)).cast("int")


def md5_shard(key: Column, n: int, seed: int = 0) -> Column:
    """Shard by a hash that any engine has."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n).cast("int")


def ranges(df: DataFrame, order: str, name: str, buckets: int = 1024) -> DataFrame:
    """df with name, the range of a numeric column that a row is in: bounds are approximate quantiles, so that ranges hold near equally many rows; nulls are the last range."""
    near = df.select(F.col(order).cast("double").alias("x")).approxQuantile("x", [k / buckets for k in range(1, buckets)], 0.25 / buckets)
    bounds = [-math.inf, *(sorted(set(near)) or [0.0]), math.inf]
    cut = Bucketizer(splits=bounds, inputCol=f"{name}_x", outputCol=name, handleInvalid="keep")
    return cut.transform(df.withColumn(f"{name}_x", F.col(order).cast("double"))).drop(f"{name}_x").withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(len(bounds))))


def positions(df: DataFrame, order: str, buckets: int = 1024) -> DataFrame:
    """df with pos, the place of each row from 0 in the order of a unique numeric column; nulls come last.

    Rows are counted by range of the column and numbered inside ranges; only the counts of
    the ranges are ordered in one task.
    """
    placed = ranges(df, order, "_b", buckets)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(F.col(order).asc_nulls_last())) - 1
    return placed.join(F.broadcast(starts), "_b").withColumn("pos", F.col("_start") + inside).drop("_b", "_start")


def equal_chunks(df: DataFrame, n: int) -> DataFrame:
    """df of positions() with chunk from 1 to n: near equal, the first ones larger by one."""
    rows = df.count()
    small, larger = divmod(rows, n)
    head = larger * (small + 1)
    pos = F.col("pos")
    at = F.when(pos < head, F.floor(pos / (small + 1))).otherwise(larger + F.floor((pos - head) / max(1, small)))
    return df.withColumn("chunk", (at + 1).cast("int"))


def round_robin(pos: Column, n: int) -> Column:
    return F.pmod(pos, F.lit(n)).cast("int")


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows a group, those first by hash of key."""
    w = Window.partitionBy(group).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def temperature_sizes(counts: DataFrame, group: str, n: str, total: int, temperature: float) -> DataFrame:
    """(group, n, sample): sizes in proportion to share ** (1 / temperature), never more than there are."""
    all_n = counts.agg(F.sum(n).alias("_all"))
    p = counts.crossJoin(F.broadcast(all_n)).withColumn("_p", F.pow(F.col(n) / F.col("_all"), F.lit(1 / temperature)))
    total_p = p.agg(F.sum("_p").alias("_sum"))
    return p.crossJoin(F.broadcast(total_p)).select(group, n, F.least(F.col(n), F.floor(F.col("_p") / F.col("_sum") * total)).alias("sample"))


def offsets(df: DataFrame, size: str, order: str, within: str, name: str, buckets: int = 1024) -> DataFrame:
    """df with the sum of sizes before each row inside its `within` group, in the order of a unique numeric column (nulls last): by range of the column first, then inside ranges."""
    cut = ranges(df, order, "_b", buckets)
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(F.col(within).alias("_w"), F.col("_b").alias("_c")).agg(F.sum(size).alias("_n"))
    sums = sums.select("_w", "_c", F.coalesce(F.sum("_n").over(ahead(Window.partitionBy("_w").orderBy("_c"))), F.lit(0)).alias("_start"))
    inside = F.coalesce(F.sum(size).over(ahead(Window.partitionBy(within, "_b").orderBy(F.col(order).asc_nulls_last()))), F.lit(0))
    placed = cut.join(sums, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_b") == F.col("_c")))
    return placed.withColumn(name, F.col("_start") + inside).drop("_b", "_w", "_c", "_start")


def running_max(cut: DataFrame, value: str, order: str, within: str, name: str, upto: int = 0) -> DataFrame:
    """df of ranges(df, order, "_b") with the greatest value of the rows of `within` up to each row (upto=-1: before it), by range first, then inside ranges; nulls are passed over."""
    tops = cut.groupBy(F.col(within).alias("_w"), F.col("_b").alias("_c")).agg(F.max(value).alias("_n"))
    before = Window.partitionBy("_w").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("_w", "_c", F.max("_n").over(before).alias("_top"))
    inside = F.max(value).over(Window.partitionBy(within, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, upto))
    placed = cut.join(tops, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_b") == F.col("_c")))
    return placed.withColumn(name, F.greatest("_top", inside)).drop("_w", "_c", "_top")
