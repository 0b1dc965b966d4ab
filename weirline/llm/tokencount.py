"""Token counts of flat, unindexed token files by a separator scan over blocks and a prefix scan between them."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirline.llm.common import Scratch

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: End-of-document identifier: the free one after the vocabulary.
EOD = 50256
BLOCK_BYTES = 1 << 20
#: Letters of a pretoken that the library is given at most.
LONG = 4096
#: Blocks whose prefixes one task sums up; above that, sums of such groups.
SUPER = 1024

# Fixed value: the pattern that splits text before merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(vocab: str):
    """encoder_of() a file that this process can read: the driver; tasks get the file's bytes."""
    return encoder_of(Path(vocab).read_bytes())


@lru_cache(maxsize=2)
def encoder_of(data: bytes):
    """The library's encoder and the ranks of its vocabulary."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


@lru_cache(maxsize=1)
def splitter():
    import regex

    return regex.compile(PATTERN)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pretoken of any length: the pair of neighbours of least rank merges first, the leftmost of equals; n log n."""
    n = len(piece)
    end, prev, alive, heap = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(b"\1") * n, []

    def offer(a: int) -> None:
        b = end[a]
        if b < n and (rank := ranks.get(piece[a : end[b]])) is not None:
            heapq.heappush(heap, (rank, a, b, end[b]))

    for i in range(n):
        offer(i)
    while heap:
        _, a, b, e = heapq.heappop(heap)
        if not (alive[a] and alive[b] and end[a] == b and end[b] == e):
            continue
        alive[b], end[a] = 0, e
        if e < n:
            prev[e] = a
        offer(a)
        if prev[a] >= 0:
            offer(prev[a])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def token_ids(text: str, enc, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a whole text. A text with a run over LONG letters is split into pretokens here, and those over LONG are
    merged here too: on such runs the library's own splitter overflows its stack. The ids are the same either way."""
    if len(text) <= LONG or (max(map(len, text.split()), default=0) <= LONG and not re.search(f"\\s{{{LONG}}}", text)):
        return enc.encode_ordinary(text)
    out: list[int] = []
    for m in splitter().finditer(text):
        out += enc.encode_ordinary(m[0]) if len(m[0]) <= LONG else merge(m[0].encode(), ranks)
    return out


def flat_stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Flat files as rows: (file, block, payload) of little-endian 16-bit ids, each text followed by EOD, cut every block_bytes
    wherever that falls; and apart from them, rows (file, ordinal, ids) that say which documents a file holds in order.

    A file is what one task reads. Null text is an empty document.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(Path(vocab).read_bytes())  # workers need no file of their own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (enc, ranks), file = encoder_of(shipped.value), f"part-{TaskContext.get().partitionId():06d}"
        rest, block, ordinal = b"", 0, 0

        def rows(payloads: list[bytes], ids: list | None) -> pa.RecordBatch:
            n = len(payloads) + (ids is not None)
            blocks = [*range(block, block + len(payloads)), *[None] * (ids is not None)]
            return pa.RecordBatch.from_arrays(
                [pa.array([file] * n), pa.array(blocks, pa.int64()), pa.array([*payloads, *[None] * (ids is not None)], pa.binary()), pa.array([*[None] * len(payloads), *([ordinal] if ids is not None else [])], pa.int64()), pa.array([*[None] * len(payloads), *([ids] if ids is not None else [])], pa.list_(pa.int64()))],
                names=["file", "block", "payload", "ordinal", "ids"],
            )

        for big in batches:
            for at in range(0, big.num_rows, 512):
                b = big.slice(at, 512)
                parts = [rest]
                for t in b.column(1):
                    parts.append(np.array([*(token_ids(t.as_py(), enc, ranks) if t.is_valid else ()), EOD], "<u2").tobytes())
                flat = b"".join(parts)
                cut = len(flat) // block_bytes * block_bytes
                payloads, rest = [flat[i : i + block_bytes] for i in range(0, cut, block_bytes)], flat[cut:]
                yield rows(payloads, b.column(0).to_pylist())
                block, ordinal = block + len(payloads), ordinal + b.num_rows
        if rest:
            yield rows([rest], None)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "file string, block long, payload binary, ordinal long, ids array<long>")


def read_flat(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, block, payload) of real flat files through Spark's reader, each of at most 2 GB (a reader's limit)."""
    whole = spark.read.format("binaryFile").load(path).where("length > 0")
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long")))
    cut = whole.select(F.col("path").alias("file"), at.alias("at"), "content")
    return cut.select("file", (F.col("at") / block_bytes).cast("long").alias("block"), F.expr(f"substring(content, cast(at + 1 as int), {block_bytes})").alias("payload"))


def scan_blocks(blocks: DataFrame, eod: int = EOD, dtype: str = "<u2") -> DataFrame:
    """(file, block, n_sep, head, tail, inner): separators of each block, the tokens before the first and after the last, and the counts between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_sep, head, tail, inner = [], [], [], []
            for x in b.column(2):
                ids = np.frombuffer(x.as_buffer(), dtype)
                at = np.flatnonzero(ids == eod)
                n_sep.append(len(at))
                head.append(int(at[0]) if len(at) else len(ids))
                tail.append(len(ids) - 1 - int(at[-1]) if len(at) else len(ids))
                inner.append(np.diff(at) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.int64()) for c in (n_sep, head, tail)), pa.array(inner, pa.list_(pa.int64()))], names=["file", "block", "n_sep", "head", "tail", "inner"])

    return blocks.select("file", "block", "payload").mapInArrow(run, "file string, block long, n_sep long, head long, tail long, inner array<long>")


def _carry(rows: DataFrame, keys: list[str], order: str, sep: str, tail: str) -> DataFrame:
    """rows with sep_before (separators before the row) and open_before (tokens since the last one) within keys."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    g = rows.withColumn("sep_before", F.coalesce(F.sum(sep).over(before), F.lit(0)))
    # tokens open before a row: tails since the last row that has a separator, that row's included
    total = F.coalesce(F.sum(tail).over(before), F.lit(0))
    g = g.withColumn("_all", total)
    reset = F.max(F.when(F.col(sep) > 0, F.struct(F.col(order), F.col("_all")))).over(before)
    return g.withColumn("open_before", F.col("_all") - F.coalesce(reset["_all"], F.lit(0))).drop("_all")


def stitch(scanned: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens): documents of each file in order, counted across block boundaries.

    Prefixes are summed inside groups of SUPER blocks, then over the groups, so even
    one file with a third of all bytes gives no task more than SUPER rows or one row a GB.
    Tokens after a file's last separator count as a last document.
    """
    s = scanned.withColumn("super", F.floor(F.col("block") / SUPER))
    local = _carry(s, ["file", "super"], "block", "n_sep", "tail")
    last = s.where("n_sep > 0").groupBy("file", "super").agg(F.max("block").alias("last"))
    sums = s.join(last, ["file", "super"], "left").groupBy("file", "super").agg(F.sum("n_sep").alias("s_sep"), F.sum(F.when(F.col("last").isNull() | (F.col("block") >= F.col("last")), F.col("tail")).otherwise(0)).alias("s_tail"))
    outer = _carry(sums, ["file"], "super", "s_sep", "s_tail").select("file", "super", F.col("sep_before").alias("o_sep"), F.col("open_before").alias("o_open"))
    j = local.join(outer, ["file", "super"])
    opened = F.col("open_before") + F.when(F.col("sep_before") == 0, F.col("o_open")).otherwise(0)
    closed = j.where("n_sep > 0").select("file", (F.col("o_sep") + F.col("sep_before")).alias("first"), F.posexplode(F.concat(F.array(opened + F.col("head")), F.col("inner"))).alias("k", "n_tokens"))
    closed = closed.select("file", (F.col("first") + F.col("k")).alias("ordinal"), "n_tokens")
    ends = _carry_end(sums)
    return closed.unionByName(ends)


def _carry_end(sums: DataFrame) -> DataFrame:
    """What is open at the end of each file, if anything."""
    at = sums.groupBy("file").agg(F.sum("s_sep").alias("ordinal"), F.max(F.when(F.col("s_sep") > 0, F.col("super"))).alias("reset"))
    left = sums.join(at, "file").groupBy("file", "ordinal").agg(F.sum(F.when(F.col("reset").isNull() | (F.col("super") >= F.col("reset")), F.col("s_tail")).otherwise(0)).alias("n_tokens"))
    return left.where("n_tokens > 0").select("file", "ordinal", "n_tokens")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = VOCAB, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens) of every row, counted in the flat files that docs make, not from the texts.

    Null and empty texts count zero; repeated ids give a row each; empty input, empty output.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    flat = scratch.table(flat_stream(docs, id_col, text_col, vocab, block_bytes))
    scanned = scratch.table(scan_blocks(flat.where("block is not null")))
    counted = stitch(scanned)
    named = flat.where("block is null").select("file", "ordinal", F.posexplode("ids").alias("k", "id")).select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "id")
    return scratch.last(named.join(counted, ["file", "ordinal"]).select("id", "n_tokens"))
