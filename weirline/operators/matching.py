"""Exclusive matching: pairs taken best first, where a pair rules out all that touch what it conflicts with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.operators.rounds import checkpointed


def symmetric(overlaps: DataFrame) -> DataFrame:
    """(key, a, b) of overlapping pairs (key, a, b) both ways."""
    return overlaps.select("key", "a", "b").unionByName(overlaps.select("key", F.col("b").alias("a"), F.col("a").alias("b")))


def exclusive_matches(pairs: DataFrame, conflicts_i: DataFrame, conflicts_j: DataFrame) -> DataFrame:
    """(key, i, j, score) that taking the best remaining pair again and again gives, each time striking all pairs of i, of j and of what conflicts with either.

    pairs (key, i, j, score) count where score > 0; ties go to the smaller i, then j.
    conflicts (key, a, b), both ways, are of one side each. A round takes every pair that
    is the best of all it conflicts with: the sequential rule would take it too, since
    nothing better can strike it. So rounds are few, and no key's pairs are gathered.
    """
    best = F.struct(F.col("score"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
    rest = checkpointed(pairs.where("score > 0").select("key", "i", "j", "score", best.alias("o")))
    taken = []

    def leading(side: str, near: DataFrame) -> DataFrame:
        """(key, side, lead): the best pair among those of an item and of what conflicts with it."""
        own = rest.groupBy("key", F.col(side).alias("b")).agg(F.max("o").alias("o"))
        around = near.join(own, ["key", "b"]).select("key", F.col("a").alias("b"), "o")
        return own.unionByName(around).groupBy("key", F.col("b").alias(side)).agg(F.max("o").alias(f"lead_{side}"))

    def without(df: DataFrame, won: DataFrame, side: str, near: DataFrame) -> DataFrame:
        own = won.select("key", F.col(side).alias("a"))
        gone = own.unionByName(near.join(own, ["key", "a"]).select("key", F.col("b").alias("a"))).distinct()
        return df.join(gone.withColumnRenamed("a", side), ["key", side], "left_anti")

    while not rest.isEmpty():
        led = rest.join(leading("i", conflicts_i), ["key", "i"]).join(leading("j", conflicts_j), ["key", "j"])
        won = checkpointed(led.where("o = lead_i and o = lead_j").select("key", "i", "j", "score"))
        taken.append(won)
        rest = checkpointed(without(without(rest, won, "i", conflicts_i), won, "j", conflicts_j).select("key", "i", "j", "score", "o"))
    return reduce(DataFrame.unionByName, taken) if taken else rest.drop("o")
