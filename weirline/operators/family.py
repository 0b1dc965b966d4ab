"""Nearest relatives in a tree, by the best descendant of the closest ancestor, and by place on the globe where there is none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.operators import mining
from weirline.operators.rounds import checkpointed

#: Levels a tree has at most; a deeper one, or a circle, is an error.
DEEPEST = 100


def ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor, up) of nodes (id, parent): every node's ancestors, itself included at up 0; one join a level."""
    parents = nodes.where("parent is not null").select(F.col("id").alias("ancestor"), "parent").distinct()
    level = checkpointed(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("up")).distinct())
    levels = [level]
    while not level.isEmpty():
        if len(levels) > DEEPEST:
            raise ValueError(f"more than {DEEPEST} levels, or a circle")
        level = checkpointed(level.join(parents, "ancestor").select("id", F.col("parent").alias("ancestor"), (F.col("up") + 1).alias("up")))
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def nearest_relatives(nodes: DataFrame, targets: DataFrame, not_itself: bool = False) -> DataFrame:
    """(id, relative, up) of every node that has one: of the targets (id, weight) below its closest ancestor with any, the heaviest, then the smallest id.

    A target is its own relative (up 0), unless not_itself.
    """
    line = checkpointed(ancestors(nodes))
    below = line.join(targets, "id").select("ancestor", F.col("id").alias("relative"), F.struct(-F.col("weight"), F.col("id")).alias("o"))
    # the two best are enough: one of them is not the node itself
    first = below.groupBy("ancestor").agg(F.min("o").alias("o"))
    if not_itself:
        rest = below.join(first.withColumnRenamed("o", "best"), "ancestor").where("o > best").groupBy("ancestor").agg(F.min("o").alias("o"))
        first = first.unionByName(rest)
    found = line.join(first.select("ancestor", F.col("o.id").alias("relative"), "o"), "ancestor")
    found = found.where("relative <> id") if not_itself else found
    return found.groupBy("id").agg(F.min(F.struct("up", "o")).alias("m")).select("id", F.col("m.o.id").alias("relative"), "m.up")


def on_sphere(latitude: Column, longitude: Column) -> Column:
    """The unit vector of a place: the great-circle distance falls with the inner product."""
    a, b = F.radians(latitude), F.radians(longitude)
    return F.array(F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))


def nearest_places(places: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, relative): the target (id, latitude, longitude) closest to each place, the smaller id of equally close ones; numeric ids, rows without a place have none."""
    at = lambda df: df.where("latitude is not null and longitude is not null").select("id", on_sphere(F.col("latitude"), F.col("longitude")).alias("vec"))
    return mining.knn(at(places), at(targets), 1).select(F.col("q_id").alias("id"), F.col("b_id").alias("relative"))
