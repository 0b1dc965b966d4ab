"""Pluggable batch models: encoders and classifiers behind one iterator interface, with a deterministic stand-in."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashEncoder:
    """Letter trigrams hashed to signed dimensions: the same vectors everywhere, close for close texts."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out, seen = np.zeros((len(texts), self.dim)), {}
        for row, t in zip(out, texts):
            t = f"  {t} "
            for gram, n in Counter(map("".join, zip(t, t[1:], t[2:]))).items():
                if gram not in seen:
                    h = xxhash.xxh64_intdigest(gram)
                    seen[gram] = h % self.dim, 1 if h >> 63 else -1
                at, sign = seen[gram]
                row[at] += sign * n
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, make: Callable[[], Encoder], out: str = "embedding") -> DataFrame:
    """Adds vectors of a text column; the model is made once a task, null texts give null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            vec = list(model.encode(s.fillna("").tolist()))
            yield pd.Series([v if ok else None for v, ok in zip(vec, s.notna())], dtype=object)

    return df.withColumn(out, run(text))


def map_distinct(df: DataFrame, key: str, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """f (key -> key and results) on the different keys only, joined back: repeated keys cost once."""
    return df.join(f(df.select(key).distinct()), key, "left")


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Batch mapper: a batch gives any number of rows, or None for none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if (out := f(b)) is not None:
                yield out

    return df.mapInPandas(run, schema)


def apply_over_groups(df: DataFrame, keys: list[str | None] | None, mapper: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """mapper (Arrow table to table, any number of rows) over each group of the keys; null keys make a group of their own.

    Without a key (none, or only None) the mapper gets batches as they come. A mapper
    holds a whole group: for groups beyond a task's memory cut them by a further key. The
    order of rows is a column of df (sampling.positions) that the mapper keeps.
    """
    given = [k for k in keys or [] if k is not None]
    if given:
        return df.groupBy(*given).applyInArrow(mapper, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from mapper(pa.Table.from_batches([b])).to_batches()

    return df.mapInArrow(run, schema)


def table_hash(df: DataFrame, cols: list[str]) -> DataFrame:
    """(n, content, columns): rows, a sum of row hashes, which no order changes, and a hash of the column names."""
    digest = F.md5(F.concat_ws("\u0001", *(F.col(c).cast("string") for c in cols)).cast("binary"))
    content = F.sum(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))
    return df.agg(F.count("*").alias("n"), content.alias("content")).withColumn("columns", F.md5(F.lit(",".join(cols)).cast("binary")))


def infer_schema(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame | None], rows: int = 10, tries: int = 3) -> str:
    """DDL of a batch mapper's output, from its output on the first rows, ten times as many on each further try."""
    for k in range(tries):
        out = mapper(df.limit(rows * 10**k).toPandas())
        if out is not None and len(out):
            return df.sparkSession.createDataFrame(out).schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    raise ValueError("the mapper gave no rows")


def map_reduce_lines(df: DataFrame, mapper: Callable[[pd.DataFrame], pd.DataFrame], schema: str, merge: list) -> DataFrame:
    """Batches mapped to partial results, merged by aggregates."""
    return map_batches(df, mapper, schema).agg(*merge)
