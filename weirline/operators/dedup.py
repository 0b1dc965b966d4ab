"""Exact dedup by ordered windows and evaluation-set decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def staged(df: DataFrame, src: str, tgt: str, order: list, max_target: int | None = None, max_source: int | None = None) -> DataFrame:
    """Pairs once, then at most max_target rows a target among those, then max_source a source among the rest."""
    out = first_per_key(df, [src, tgt], order)
    for key, most in ((tgt, max_target), (src, max_source)):
        if most is not None:
            w = Window.partitionBy(key).orderBy(*order)
            out = out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")
    return out


def seen_flags(df: DataFrame, src: str, tgt: str, order: list[str]) -> DataFrame:
    """first_pair, first_src, first_tgt: whether a row is the first of its pair, source and target by `order`; rejected rows count as seen.

    Keys are 128 bits of hashes, so no text is exchanged: firsts of all three kinds are
    partial minima of one narrow table, and what they say goes back by the order columns.
    """

    def named(kind: int, *cols: str) -> Column:
        own = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
        return F.struct(F.lit(kind).alias("kind"), F.xxhash64(*own).alias("h1"), F.xxhash64(F.lit(1), *own).alias("h2"))

    keys = F.explode(F.array(named(0, src, tgt), named(1, src), named(2, tgt))).alias("k")
    firsts = df.select(*order, keys).groupBy("k").agg(F.min(F.struct(*order)).alias("at"))
    flags = firsts.groupBy("at").agg(*(F.max(F.col("k.kind") == n).alias(c) for n, c in enumerate(("first_pair", "first_src", "first_tgt"))))
    flags = flags.select(*(F.col(f"at.{c}").alias(f"_{c}") for c in order), "first_pair", "first_src", "first_tgt")
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    back = df.join(flags, same, "left").drop(*(f"_{c}" for c in order))
    return back.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("first_pair", "first_src", "first_tgt")})


def without_seen(train: DataFrame, evaluation: DataFrame, key: Column, name: str = "_key") -> DataFrame:
    """Rows of train whose key no row of evaluation has: one left_anti join on the normalised key."""
    seen = evaluation.select(key.alias(name)).distinct()
    return train.withColumn(name, key).join(seen, name, "left_anti").drop(name)
