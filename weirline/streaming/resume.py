"""Resumable map-and-write: a file stream with a checkpoint in the place of a pickled cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from weirline.operators import models


def map_files(spark: SparkSession, path: str, schema: StructType | str, mapper: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Maps the Parquet files that arrived under path since the last call and appends to out exactly once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    mapper(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@dataclass(frozen=True)
class Input:
    """Parquet files under a folder or glob, with columns and a row filter that reach the scan, a batch size and files a trigger."""

    path: str
    schema: str
    columns: tuple[str, ...] = ()
    where: str | None = None
    batch_size: int = 1000
    files_per_trigger: int = 1000
    glob: str | None = None

    def read(self, spark: SparkSession) -> DataFrame:
        r = spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files_per_trigger)
        df = (r.option("pathGlobFilter", self.glob) if self.glob else r).parquet(self.path)
        df = df.where(self.where) if self.where else df
        return df.select(*self.columns) if self.columns else df


@dataclass(frozen=True)
class Output:
    """A folder of Parquet files, perhaps by partition columns, of at most so many rows each."""

    path: str
    partition_by: tuple[str, ...] = ()
    rows_per_file: int = 0
    compression: str = "snappy"
    options: dict = field(default_factory=dict)


def rebatched(batches: Iterator[pd.DataFrame], n: int) -> Iterator[pd.DataFrame]:
    """The rows of batches in batches of exactly n; the last may be short."""
    rest: list[pd.DataFrame] = []
    have = 0
    for b in batches:
        rest.append(b)
        have += len(b)
        if have >= n:
            whole = pd.concat(rest, ignore_index=True)
            cut = have // n * n
            yield from (whole.iloc[k : k + n].reset_index(drop=True) for k in range(0, cut, n))
            rest, have = [whole.iloc[cut:]], have - cut
    if have:
        yield pd.concat(rest, ignore_index=True)


def run_mapper(spark: SparkSession, source: Input, mapper: Callable[[pd.DataFrame], pd.DataFrame | None], out: Output, checkpoint: str, schema: str | None = None) -> None:
    """A batch mapper over all files that have not been mapped yet; call it again to go on after a failure or with new files.

    A batch of exactly source.batch_size rows (the last of a task may be short) gives any
    number of rows or None. The output schema is given or inferred on the first rows. What
    a trigger wrote is committed with its place in the input, so no row is lost or doubled.
    """
    rows = source.read(spark)
    if schema is None:
        first = spark.read.schema(source.schema).parquet(source.path)
        first = first.where(source.where) if source.where else first
        schema = models.infer_schema(first.select(*source.columns) if source.columns else first, mapper)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rebatched(batches, source.batch_size):
            if (made := mapper(b)) is not None:
                yield made

    w = rows.mapInPandas(run, schema).writeStream.format("parquet").option("path", out.path).option("compression", out.compression).option("checkpointLocation", checkpoint)
    w = w.option("maxRecordsPerFile", out.rows_per_file) if out.rows_per_file else w
    w = w.options(**out.options) if out.options else w
    (w.partitionBy(*out.partition_by) if out.partition_by else w).trigger(availableNow=True).start().awaitTermination()
