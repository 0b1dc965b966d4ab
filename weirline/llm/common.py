"""Shared pieces of the llm operators: scratch tables and distributed connected components."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a local one only where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (base or f"file://{LOCAL_SCRATCH}").rstrip("/")


class Scratch:
    """Tables written below the shared folder to cut lineage.

    A lost executor costs nothing: what was written is committed Parquet that every
    executor can read. Tables go by drop() or last(), the rest when the session's file system closes.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root = spark, f"{scratch_root(spark)}/weirline-{tag}-{uuid.uuid4().hex}"
        self.n, self.live = 0, []
        path = self._path(self.root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)  # deleteOnExit takes no note of a folder that is not there yet
        fs.deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, schema = f"{self.root}/{self.n}", df.schema
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        self.live.append(path)
        del df
        self.spark.sparkContext._jvm.System.gc()  # the written job's shuffle files go once its plan is collected, not half an hour later
        return out

    def drop(self, *tables: DataFrame) -> None:
        self._delete([t._scratch_path for t in tables])

    def last(self, df: DataFrame) -> DataFrame:
        """Writes a result that is small against its inputs and drops all tables before it."""
        before = list(self.live)
        out = self.table(df)
        self._delete(before)
        return out

    def _delete(self, names: list[str]) -> None:
        for name in names:
            if name in self.live:
                self.live.remove(name)
                path = self._path(name)
                path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of edges (u, v); component is the smallest node reachable.

    Contraction: each node hooks onto the smallest of itself and its neighbours, two
    pointer jumps shorten the chains, and the edges are rewritten between the nodes
    hooked onto. Nodes that stay are at most one per neighbourhood, so edges shrink by
    a factor each round and no round gathers a node's neighbours anywhere: hooks are
    partial min-aggregates and the rest are equi-joins that AQE may split. The driver
    sees one count a round.
    """
    e = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v")
    e = scratch.table(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    hooks: list[DataFrame] = []
    while e.count():
        near = scratch.table(e.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")))
        hook = near
        for _ in range(2):
            nxt = hook.select(F.col("u").alias("to"), F.col("to").alias("far"))
            hook = hook.join(nxt, "to", "left").select("u", F.coalesce("far", "to").alias("to"))
        hook = scratch.table(hook)
        scratch.drop(near)
        a, b = hook.toDF("u", "a"), hook.toDF("v", "b")
        nxt = e.join(a, "u").join(b, "v").select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct()
        nxt = scratch.table(nxt)
        scratch.drop(e)
        e = nxt
        hooks.append(hook)
    if not hooks:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    label = hooks[-1]
    for hook in reversed(hooks[:-1]):
        far = label.select(F.col("u").alias("to"), F.col("to").alias("far"))
        label = hook.join(far, "to", "left").select("u", F.coalesce("far", "to").alias("to"))
    return label.select(F.col("u").alias("node"), F.col("to").alias("component"))
