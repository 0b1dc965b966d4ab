"""Readers and writers: Parquet, delimited text, JSON lines, plain lines with numbers, bitext."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.sources.files import numbered_lines

# Decimal and binary size units.
UNITS = {"": 1, "K": 1024, "M": 1024**2, "G": 1024**3, "T": 1024**4, "P": 1024**5, "KB": 1000, "MB": 1000**2, "GB": 1000**3, "TB": 1000**4, "PB": 1000**5}


def parse_size(text: str) -> int:
    m = re.fullmatch(r"\s*(\d+)\s*([KMGTP]?B?)\s*", text.upper())
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) * UNITS[m[2]]


def read_parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Rows of Parquet files; the filter is a SQL expression and, with the columns, reaches the scan."""
    df = spark.read.parquet(*paths)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def read_delimited(spark: SparkSession, path, schema: str | None = None, sep: str = "\t", header: bool = True, path_column: str | None = None) -> DataFrame:
    r = spark.read.option("sep", sep).option("header", header).option("quote", "")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.withColumn(path_column, F.col("_metadata.file_path")) if path_column else df


def read_json_lines(spark: SparkSession, path: str, schema: str, first: int | None = None) -> DataFrame:
    """Top-level keys of JSON lines, of the first lines of each file only where `first` says so."""
    if first is None:
        return spark.read.schema(schema).json(path)
    lines = numbered_lines(spark, path).where(F.col("line_no") < first)
    return lines.select(F.from_json("text", schema).alias("r")).select("r.*")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no, text): numbers from 0 in each file."""
    return numbered_lines(spark, *paths).select("file", "line_no", "text")


def zip_lines(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional join of two line tables of one file each by line number."""
    return left.select("line_no", F.col("text").alias("src")).join(right.select("line_no", F.col("text").alias("tgt")), "line_no")


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, rows_per_file: int | None = None, compression: str = "snappy", mode: str = "error") -> None:
    w = df.write.mode(mode).option("compression", compression)
    w = w.option("maxRecordsPerFile", rows_per_file) if rows_per_file else w
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, compression: str = "none", mode: str = "error") -> None:
    df.write.mode(mode).option("sep", sep).option("header", header).option("compression", compression).csv(path)
