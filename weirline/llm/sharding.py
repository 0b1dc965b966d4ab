"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly, equal texts together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirline.llm.common import Scratch

SHARDS = 8
#: Groups of equal texts are packed alone if they hold over 1 / ALONE of anything, else in one of BUNDLES bundles.
ALONE = 8192
BUNDLES = 8192
#: A group over 1 / SPLIT of a shard is packed in pieces of at most that.
SPLIT = 4
#: Parts of a shard, at least, whose rows are numbered apart.
SLOT_PARTS = 256
WORD = r"[^\x20\x09-\x0D]+"


def pack(load: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each item (rows of load: bytes, tokens, rows).

    Items go largest first to the shard whose residual capacity has the highest dot
    product with the item, both as shares of the totals; shards that would pass their
    even share in bytes by more than the item leaves the others wait. Ends with moves
    and swaps of small items until bytes are near equal.
    """
    total = load.sum(0)
    share = load / np.where(total > 0, total, 1)
    left = np.full((shards, load.shape[1]), 1 / shards)
    out = np.zeros(len(load), np.int64)
    for i in np.lexsort((np.arange(len(load)), -share.max(1))):
        v = share[i]
        fits = left[:, 0] >= v[0]
        score = left @ v
        k = int(np.argmax(np.where(fits, score, -np.inf))) if fits.any() else int(np.argmax(left[:, 0]))
        out[i] = k
        left[k] -= v
    _even_out(load[:, 0].astype(np.int64), out, shards)
    return out


def _even_out(size: np.ndarray, out: np.ndarray, shards: int) -> None:
    """Moves of one item from the fullest to the emptiest shard while that narrows the gap."""
    total = np.bincount(out, size, shards).astype(np.int64)
    for _ in range(64 * shards):
        hi, lo = int(total.argmax()), int(total.argmin())
        gap = int(total[hi] - total[lo])
        mine = np.flatnonzero((out == hi) & (size < gap) & (size > 0))
        if gap <= 1 or not len(mine):
            return
        i = mine[np.abs(2 * size[mine] - gap).argmin()]
        out[i] = lo
        total[hi] -= size[i]
        total[lo] += size[i]


def _large(groups: DataFrame, totals: list[int], shards: int) -> DataFrame:
    """(gid, pieces) of the groups (gid, rows, bytes, tokens) over 1 / ALONE of anything: at most 3 * ALONE rows."""
    share = F.greatest(*(F.col(c) / F.lit(max(1, t)) for c, t in zip(("bytes", "tokens", "rows"), totals)))
    pieces = F.when(share > 1 / (shards * SPLIT), F.ceil(share * shards * SPLIT).cast("int")).otherwise(1)
    return groups.where(share > 1 / ALONE).select("gid", pieces.alias("pieces"))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, tokens, shard, slot): law `bytes`, sizes near equal.

    Size is UTF-8 bytes plus 1; tokens are words between ASCII white space. Texts are read
    once, to a narrow scratch table. Groups of equal texts are pre-aggregated; those with
    over 1/8192 of bytes, tokens or rows are packed alone (at most 3 * 8192, broadcast), the
    rest in 8192 bundles by hash, so what the driver packs and what is broadcast has at most
    32,768 rows at any input size (a row is about 60 bytes), and rows meet no other by text. A group
    with over a quarter of a shard is packed in pieces by row number, so a group may hold a
    third of all rows. Slots count from 0 in each shard without a gap: rows are numbered
    inside parts of at most about a million rows, and part counts are summed up.
    Null text: size 1, CRC zero. Null ids and repeated rows get their own slots. Empty
    input: empty output. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = scratch.table(
        docs.select(
            F.col(id_col).cast("long").alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
            F.md5(text.cast("binary")).alias("gid"),
            F.xxhash64(F.monotonically_increasing_id()).alias("row"),  # fixed once the table is written
        )
    )
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    totals = [int(x or 0) for x in total]
    groups = rows.groupBy("gid").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    large = scratch.table(_large(groups, totals, shards))
    own = F.when(F.col("pieces") > 1, F.concat(F.lit("g"), F.col("gid"), F.lit("."), F.pmod("row", F.col("pieces")))).otherwise(F.concat(F.lit("g"), F.col("gid")))
    bundle = F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("gid"), F.lit(BUNDLES)))).otherwise(own)
    placed = rows.join(F.broadcast(large), "gid", "left").withColumn("bundle", bundle).select("id", "size", "text_crc32", "tokens", "bundle", "row")
    loads = placed.groupBy("bundle").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("bundle").collect()
    at = pack(np.array([tuple(r)[1:] for r in loads], float).reshape(-1, 3), shards)
    chosen = spark.createDataFrame([(r[0], int(k)) for r, k in zip(loads, at)], "bundle string, shard int")
    parts = max(SLOT_PARTS, totals[2] // (shards << 20))
    dealt = placed.join(F.broadcast(chosen), "bundle").withColumn("part", F.pmod("row", F.lit(parts)).cast("int")).drop("bundle")
    return _numbered(scratch.table(dealt), spark)


def _numbered(rows: DataFrame, spark: SparkSession) -> DataFrame:
    counts = sorted(map(tuple, rows.groupBy("shard", "part").count().collect()))  # a row for 2048 parts, or a million rows
    base, seen = [], {}
    for k, p, n in counts:
        base.append((k, p, seen.get(k, 0)))
        seen[k] = seen.get(k, 0) + n
    first = spark.createDataFrame(base, "shard int, part int, first long")
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "row"))
    numbered = rows.withColumn("slot", within)
    return numbered.join(F.broadcast(first), ["shard", "part"]).select("id", "size", "text_crc32", "tokens", "shard", (F.col("first") + F.col("slot") - 1).cast("long").alias("slot"))
