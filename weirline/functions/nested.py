"""Nested arrays: parallel explode, chunks, packs, hstack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_with_null(df: DataFrame, *cols: str) -> DataFrame:
    """Parallel explode; a null list gives one null row, an empty list none."""
    zipped = F.arrays_zip(*(F.coalesce(F.col(c), F.array(F.lit(None))).alias(c) for c in cols))
    rest = [c for c in df.columns if c not in cols]
    return df.select(*rest, F.explode(zipped).alias("_z")).select(*rest, *(F.col(f"_z.{c}").alias(c) for c in cols))


def chunks(c: Column, n: int) -> Column:
    """Slices of at most n elements; a null or empty list is one chunk."""
    # bound in an array of one, so that the list is worked out once and not for each chunk
    cut = lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(1), F.size(x), F.lit(n)), lambda i: F.slice(x, i, n))).otherwise(F.array(x))
    return F.transform(F.array(c), cut)[0]


def pack(df: DataFrame, value: str, order: str, length: int, within: str) -> DataFrame:
    """Elements of a list column in sequence across rows, cut to packs of `length` inside each `within` group.

    Offsets are sums of list sizes (operators.sampling.offsets), so a group of a third of
    all rows is not ordered in one task; rows with a null order come last.
    """
    from weirline.operators.sampling import offsets

    sized = df.withColumn("_n", F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)))
    placed = offsets(sized, "_n", order, within, "_at")
    items = placed.select(within, order, "_at", F.posexplode(value).alias("_k", "_v")).withColumn("pos", F.col("_at") + F.col("_k"))
    packed = items.groupBy(within, F.floor(F.col("pos") / length).alias("pack")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("_v").alias("v"), F.col(order).alias("o")))).alias("x"))
    return packed.select(within, "pack", F.col("x.v").alias("items"), F.col("x.o").alias("rows"))


def first_of_each(c: Column) -> Column:
    return F.transform(c, lambda x: F.get(x, F.lit(0)))
