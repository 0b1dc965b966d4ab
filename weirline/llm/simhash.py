"""SimHash near-duplicates by multi-index hashing over segments of a 64-bit fingerprint."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import Scratch, connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
#: (lowest bit, width, radius) of each segment. The radii plus one sum to 5 > RADIUS, so two
#: fingerprints at most RADIUS apart agree within its radius on one segment at least.
SEGMENTS = ((0, 21, 1), (21, 21, 1), (42, 22, 0))
#: (blocks, agreeing) of indexes without balls: RADIUS bits touch at most that many of the blocks, so the others, three of seven or four of eight, agree.
BLOCKS = ((7, 3), (8, 4))
#: Rows a bucket has on average, of evenly spread fingerprints, beyond which an index of wider keys is taken.
MEMBERS = 256
#: Members of a segment bucket beyond which its members meet through ball centres instead.
HOT_BUCKET = 8192


def hashes(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of `shingle` words of whole UTF-8 text, of all words where there are fewer; none without a word."""
    words = text.lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that over half of h have, as an unsigned number; zero for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of whole UTF-8 text; zero where there is no word."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long; null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in b.column(1).cast(pa.binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


Layout = list[tuple[tuple[tuple[int, int], ...], int]]


def layouts() -> list[tuple[float, Layout]]:
    """(share of all rows that a bucket holds, segments), narrow keys first; a segment is its parts (lowest bit, width) and a radius.

    Each layout finds every pair at most RADIUS bits apart. SEGMENTS writes about 24 keys a
    row, of 21 and 22 bits (itself and one turned-on bit of those at zero); three of seven
    blocks 35 keys of 27 bits, four of eight 70 keys of 32 bits.
    """
    share = max((1 + r * width / 2) / (1 << width) for _, width, r in SEGMENTS)
    out: list[tuple[float, Layout]] = [(share, [(((low, width),), r) for low, width, r in SEGMENTS])]
    for n, agreeing in BLOCKS:
        cuts = [64 * k // n for k in range(n + 1)]
        parts = [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]
        every: Layout = [(c, 0) for c in combinations(parts, agreeing)]
        out.append((max(2.0 ** -sum(w for _, w in c) for c, _ in every), every))
    return out


def layout(rows: int) -> Layout:
    """The first of layouts() whose buckets hold at most MEMBERS rows on average, the last where none does."""
    every = layouts()
    return next((x for share, x in every if rows * share <= MEMBERS), every[-1][1])


def segment_keys(segments: Layout) -> str:
    """SQL array of structs (key, exact): the segment values of fp, and those one 0-bit away where the radius is 1.

    Of two values one bit apart one has the 0-bit there, so turning on 0-bits is enough.
    """
    out = []
    for i, (blocks, radius) in enumerate(segments):
        at = np.cumsum([0] + [w for _, w in blocks]).tolist()
        value = " | ".join(f"shiftleft(shiftrightunsigned(fp, {low}) & {(1 << width) - 1}L, {place})" for (low, width), place in zip(blocks, at))
        value, tag = f"({value})", f"{i << 32}L"
        out.append(f"array(struct({value} | {tag} as key, true as exact))")
        if radius:
            out.append(
                f"transform(filter(sequence(0, {at[-1] - 1}), b -> ({value} & shiftleft(1L, b)) = 0L),"
                f" b -> struct({value} | shiftleft(1L, b) | {tag} as key, false as exact))"
            )
    return f"concat({', '.join(out)})"


class Forest:
    """Union-find that says which unions joined two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def near(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= radius  # of a signed number it counts the magnitude's bits


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, exact ones first: (u, v) that join two trees of this task's forest, or (u, null) of hot buckets."""
    forest, hot_key = Forest(), None
    rest = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]

    def found(key, fp, rep, exact) -> list[tuple[int, int]]:
        out, i = [], np.flatnonzero(exact)
        d = 1
        while len(i):
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
            hit = i[near(fp[i], fp[i + d])]
            out += [(a, b) for a, b in zip(rep[hit].tolist(), rep[hit + d].tolist()) if forest.join(a, b)]
            d += 1
        if len(forest.up) > 1_000_000:
            forest.up.clear()  # later edges may repeat a path; none is lost
        return out

    def batch(pairs: list[tuple[int, int]], hot: list[int]) -> pa.RecordBatch:
        u = [a for a, _ in pairs] + hot
        v = [b for _, b in pairs] + [None] * len(hot)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for b in batches:
        cols = [np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip(rest, b.columns)]
        hot: list[int] = []
        if hot_key is not None:  # the rest of a bucket that is known to be hot
            n = int(np.searchsorted(cols[0], hot_key, "right"))
            hot += cols[2][:n].tolist()
            cols = [c[n:] for c in cols]
            hot_key = hot_key if not len(cols[0]) else None
        key = cols[0]
        if not len(key):
            rest = cols
            yield batch([], hot)
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        big = sizes > HOT_BUCKET
        keep = np.repeat(~big, sizes)
        hot += cols[2][~keep].tolist()
        if big[-1]:
            hot_key, cut = int(key[-1]), len(key)
        done = keep.copy()
        done[cut:] = False
        rest = [c[cut:] for c in cols]
        yield batch(found(*(c[done] for c in cols)), hot)
    if len(rest[0]):
        yield batch(found(*rest), [])


def ball_masks(radius: int = RADIUS // 2) -> list[int]:
    """All 64-bit masks of at most radius bits, signed. Two values at most 2 * radius apart share a centre."""
    one = [1 << i for i in range(64)]
    masks = [0, *one] + ([a | b for i, a in enumerate(one) for b in one[:i]] if radius > 1 else [])
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def hot_links(hot: DataFrame) -> DataFrame:
    """Edges (u, v) that connect (fp, rep) rows at most RADIUS apart, linear in the rows: rows meet at the centres of their balls."""
    masks = hot.sparkSession.createDataFrame([(ball_masks(),)], "masks array<long>")
    met = hot.crossJoin(F.broadcast(masks)).select("rep", F.explode("masks").alias("mask"), "fp").select("rep", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    least = met.groupBy("at").agg(F.min("rep").alias("v"), F.max("rep").alias("w")).where("v < w").drop("w")
    return met.join(least, "at").select(F.col("rep").alias("u"), "v").where("u <> v").distinct()


def linked(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (u, v) that connect the reps of (fp, rep), each fp once, at most RADIUS bits apart: a forest of each task's, not all links.

    Each fingerprint writes its segment values and their Hamming balls; equal keys meet in
    sorted partitions, where full distances are verified and only forest edges leave. A
    bucket of more than HOT_BUCKET members is not compared in pairs: its members meet at
    ball centres. The index's keys widen with the count of fingerprints (layout()); reps is
    a written table, so that its rows are counted from its footers.
    """
    keyed = reps.selectExpr("fp", "rep", f"explode({segment_keys(layout(reps.count()))}) as k").selectExpr("k.key as key", "fp", "rep", "k.exact as exact")
    dealt = keyed.repartition("key").sortWithinPartitions("key", F.desc("exact"), "fp")
    links = scratch.table(dealt.mapInArrow(_links, "u long, v long"))
    edges = links.where("v is not null")
    if not links.where("v is null").isEmpty():
        hot = links.where("v is null").select(F.col("u").alias("rep")).distinct()
        edges = edges.union(hot_links(reps.join(hot, "rep")))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component): component is the smallest id whose fingerprint is reachable by links of at most RADIUS bits.

    Rows with equal fingerprints count once (pre-aggregated to their smallest id), so a
    group of copies of any size is one row in the index.
    Null or blank text: fingerprint zero, linked like any other. Repeated ids are kept.
    Empty input: empty output.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col))
    reps = scratch.table(fps.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"))
    parts = connected_components(linked(reps, scratch), scratch)
    named = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component"))
    return scratch.last(fps.join(named, "fp", "left").select("id", "fp", F.coalesce("component", "id").alias("component")))
