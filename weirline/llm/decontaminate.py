"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle check."""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import Scratch

SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints of a window and an item at similarity 0.8 differ in about 19 of 128 bits (deviation 4); 31 is three deviations off.
RADIUS = 31
#: Two fingerprints at most RADIUS apart differ in at most RADIUS // BLOCKS = 3 of the 16 bits of some block.
BLOCKS = 8
#: Bytes of benchmark text that one pass over the documents carries to the tasks; a larger benchmark takes more passes.
PASS_BYTES = 2 << 20

_FOLD = bytes.maketrans(bytes(range(65, 91)) + string.punctuation.encode(), bytes(range(97, 123)) + b" " * len(string.punctuation))
_BALL = np.flatnonzero(np.bitwise_count(np.arange(1 << 16)) <= RADIUS // BLOCKS).astype(np.uint16)
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space and punctuation, A-Z in lower case."""
    return text.encode("utf-8", "replace").translate(_FOLD).split()


def shingles(words: list[bytes], n: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each n consecutive words, of the whole sequence if it is shorter."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1)
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = (h ^ (w[k : len(w) - n + 1 + k] * _MIX[k])) * _MIX[1]
        h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ (h >> np.uint64(32))


def window_prints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """128-bit SimHash, as two longs, of the n shingles from each start, by sums over a prefix; starts is sorted."""
    lo, hi = int(starts[0]), int(starts[-1]) + n
    wide = np.stack((h[lo:hi], h[lo:hi] * _MIX[3] ^ (h[lo:hi] * _MIX[4] >> np.uint64(31))), 1)
    bits = np.unpackbits(wide.view(np.uint8), axis=1, bitorder="little")
    sums = np.zeros((hi - lo + 1, 128), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    at = starts - lo
    return np.packbits(2 * (sums[at + n] - sums[at]) > n, axis=1, bitorder="little").view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two multisets of shingles."""
    u, na = np.unique(a, return_counts=True)
    v, nb = np.unique(b, return_counts=True)
    both, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    least = int(np.minimum(na[i], nb[j]).sum())
    return least / (len(a) + len(b) - least)


@dataclass
class Group:
    """Items of one number of words: fingerprints, and for each block a sorted table of the values within RADIUS // BLOCKS bits of an item's."""

    size: int
    items: list[int] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)

    def build(self) -> Group:
        self.n = len(self.parts[0])
        self.prints = np.concatenate([window_prints(p, np.array([0]), self.n) for p in self.parts])
        self.table = []
        for block in self.prints.view(np.uint16).reshape(-1, BLOCKS).T:
            near = (block[:, None] ^ _BALL[None, :]).ravel()
            order = np.argsort(near, kind="stable")
            self.table.append((near[order], (order // len(_BALL)).astype(np.int32)))
        return self

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of at most RADIUS bits, each once: looked up by block, then by full distance."""
        found = [np.empty(0, np.int64)]
        for value, (near, item) in zip(prints.view(np.uint16).reshape(-1, BLOCKS).T, self.table):
            lo, hi = np.searchsorted(near, value), np.searchsorted(near, value, "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found.append(np.repeat(np.arange(len(value)), n) * len(self.items) + item[at])
        w, i = np.divmod(np.unique(np.concatenate(found)), len(self.items))
        ok = np.bitwise_count(prints[w] ^ self.prints[i]).sum(1) <= RADIUS
        return w[ok], i[ok]


class Index:
    def __init__(self, items: list[tuple[int, str]]):
        by: dict[int, Group] = {}
        sizes: dict[int, set[int]] = {}
        for item, text in items:
            words = words_of(text)
            if not words:
                continue
            g = by.setdefault(len(words), Group(len(words)))
            g.items.append(item)
            g.parts.append(shingles(words))
            for h in g.parts[-1].tolist():
                sizes.setdefault(h, set()).add(len(words))
        self.groups = {n: g.build() for n, g in by.items()}
        self.sizes = sizes
        self.known = np.array(sorted(sizes), np.uint64)
        self.sketch = np.zeros(1 << 20, bool)
        self.sketch[self.known & np.uint64((1 << 20) - 1)] = True
        self.short = sorted(n for n in by if n < SHINGLE)
        self.longest = max(by, default=0)

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """Places whose shingle some item has. A window without one has similarity zero to every item."""
        at = np.flatnonzero(self.sketch[h & np.uint64((1 << 20) - 1)])
        if len(at):
            k = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
            at = at[self.known[k] == h[at]]
        return at

    def search(self, text: str | None) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word of the best window, leftmost of equals) at SIMILARITY or more."""
        words = words_of(text) if text else []
        best: dict[int, tuple[float, int]] = {}
        if not words or not self.groups:
            return best
        for n in [SHINGLE, *self.short]:
            if n > len(words) and n != SHINGLE:
                continue
            h = shingles(words, n)
            at = self.anchors(h)
            if not len(at):
                continue
            wanted: dict[int, list[int]] = {}
            for p in at.tolist():
                for size in self.sizes[int(h[p])]:
                    if min(size, SHINGLE, len(words)) == min(n, len(words)):
                        wanted.setdefault(size, []).append(p)
            for size, places in wanted.items():
                self._windows(h, np.array(places), self.groups[size], best)
            if len(words) < SHINGLE:
                break
        return best

    def _windows(self, h: np.ndarray, places: np.ndarray, g: Group, best: dict) -> None:
        n = min(g.n, len(h))
        starts = np.unique(np.clip(places[:, None] - np.arange(n)[None, :], 0, len(h) - n))
        runs = np.split(starts, np.flatnonzero(np.diff(starts) > n) + 1)
        for run in runs:
            for lo in range(0, len(run), 4096):
                part = run[lo : lo + 4096]
                w, i = g.candidates(window_prints(h, part, n))
                for s, k in zip(part[w].tolist(), i.tolist()):
                    sim = similarity(h[s : s + n], g.parts[k])
                    if sim >= SIMILARITY and (-sim, s) < (-best.get(g.items[k], (0.0, 0))[0], best.get(g.items[k], (0.0, 0))[1]):
                        best[g.items[k]] = (sim, s)


_INDEX: dict[str, Index] = {}


def _kept(token: str, items) -> Index:
    """The index of one pass, built once by each worker and kept from task to task; another pass's goes."""
    if token not in _INDEX:
        _INDEX.clear()
        _INDEX[token] = Index(items.value)
    return _INDEX[token]


def passes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in slices of about pass_bytes: one, unless it is larger than that."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // pass_bytes))
    for k in range(n):
        yield [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k).orderBy("item", "text").collect()]


def _each_pass(benchmark: DataFrame, pass_bytes: int):
    """(token, broadcast slice, whether it is the only one) of each pass; the driver holds one slice at a time."""
    sc = benchmark.sparkSession.sparkContext
    slices = passes(benchmark, pass_bytes=pass_bytes)
    items, more = next(slices), next(slices, None)
    only = more is None
    while items is not None:
        yield uuid.uuid4().hex, sc.broadcast(items), only
        items, more = more, next(slices, None)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(id, item_id, similarity, start): each document and item with a window of the item's size at 0.8 or more.

    similarity is the weighted Jaccard of five-word shingles of the best window, start
    its first word from 0. A document shorter than the item is one window. Windows
    without a shingle of any item are skipped, which loses nothing; the others get a
    SimHash, and items within RADIUS bits of it come from the block index and are
    verified exactly. Map stage only; documents never meet. The benchmark is broadcast in
    slices of pass_bytes; results of more than one slice are written before the next.
    Null or wordless texts and items match nothing. Repeated rows match each; a
    repeated item_id matches by its best text. Empty tables: empty output.
    """
    out, scratch = None, Scratch(docs.sparkSession, "matches")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    for token, items, only in _each_pass(benchmark, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], token=token, items=items) -> Iterator[pa.RecordBatch]:
            index = _kept(token, items)
            for b in batches:
                found = [(i, k, s, at) for i, t in zip(b.column(0).to_pylist(), b.column(1)) for k, (s, at) in sorted(index.search(t.as_py()).items())]
                cols = list(zip(*found)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], names=["id", "item_id", "similarity", "start"])

        part = rows.mapInArrow(run, "id long, item_id long, similarity double, start long")
        part = part if only else scratch.table(part)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text has no match."""
    at, scratch = docs.columns.index(text_col), Scratch(docs.sparkSession, "clean")
    for token, items, only in _each_pass(benchmark, pass_bytes):

        def run(batches: Iterator[pa.RecordBatch], token=token, items=items) -> Iterator[pa.RecordBatch]:
            index = _kept(token, items)
            for b in batches:
                yield b.filter(pa.array([not index.search(t.as_py()) for t in b.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if only else scratch.table(docs)
    return docs
