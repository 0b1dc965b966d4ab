"""Files and their parts: discovery, numbered lines with byte offsets, shards, bitext, matrices, provenance."""

from __future__ import annotations

import io
import lzma
import re
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, is_dataclass
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirline.operators import sampling
from weirline.sources.matrix import read_matrix  # noqa: F401


def list_files(spark: SparkSession, *paths: str, suffix: str = "") -> DataFrame:
    """(path, length) of the files that files, folders and globs name; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).select("path", "length")
    return found.where(F.endswith("path", F.lit(suffix))) if suffix else found


def languages_of(files: DataFrame) -> DataFrame:
    """files with the language that the name's part before the (compression) suffix gives: corpus.eng_Latn.gz."""
    return files.withColumn("lang", F.nullif(F.regexp_extract("path", r"\.([a-z]{2,3}(?:[_-][A-Z][a-z]{3})?)(?:\.(?:gz|xz|bz2|txt|tsv))*$", 1), F.lit("")))


def corpora_of(files: DataFrame, src: str, tgt: str) -> DataFrame:
    """(corpus, src, tgt) of the folders' parallel files: the paths that differ in their language only."""
    named = languages_of(files).where(F.col("lang").isin(src, tgt)).withColumn("corpus", F.regexp_replace("path", r"\.[a-z]{2,3}(?:[_-][A-Z][a-z]{3})?((?:\.(?:gz|xz|bz2|txt|tsv))*)$", "$1"))
    both = named.groupBy("corpus").agg(F.max(F.when(F.col("lang") == src, F.col("path"))).alias("src"), F.max(F.when(F.col("lang") == tgt, F.col("path"))).alias("tgt"))
    return both.where("src is not null and tgt is not null")


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no, offset, text): numbers and byte offsets from 0 in each file; bytes that are no UTF-8 are replaced.

    Lines are numbered inside the splits Spark reads and split sums are added, so that a
    large file is never in one task. Offsets hold for uncompressed files with \\n ends.
    """
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), F.col("value").alias("raw"))
    rows = rows.withColumn("_n", F.octet_length("raw") + 1)
    inside = Window.partitionBy("file", "_start").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_line", F.count("*").over(inside)).withColumn("_byte", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ahead = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("file", "_start").agg(F.count("*").alias("_l"), F.sum("_n").alias("_b"))
    sums = sums.select("file", "_start", F.coalesce(F.sum("_l").over(ahead), F.lit(0)).alias("_l0"), F.coalesce(F.sum("_b").over(ahead), F.lit(0)).alias("_b0"))
    both = rows.join(sums, ["file", "_start"])
    return both.select("file", (F.col("_l0") + F.col("_line")).alias("line_no"), (F.col("_b0") + F.col("_byte")).alias("offset"), F.make_valid_utf8("raw").alias("text"))


def skipped(lines: DataFrame, n: int) -> DataFrame:
    """Lines after the first n of each file: where a run broke off."""
    return lines.where(F.col("line_no") >= n)


def byte_range(lines: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Lines that begin in [start, end)."""
    return lines.where((F.col("offset") >= start) & (F.lit(True) if end is None else F.col("offset") < end))


def chunk_offsets(lines: DataFrame, n: int) -> DataFrame:
    """(file, chunk, start, first_line): line-aligned byte offsets of n chunks of about equal size, and their line numbers."""
    total = lines.groupBy("file").agg(F.max(F.col("offset") + F.octet_length("text") + 1).alias("_total"))
    chunk = F.floor(F.col("offset") * n / F.col("_total")).cast("int").alias("chunk")
    return lines.join(total, "file").groupBy("file", chunk).agg(F.min("offset").alias("start"), F.min("line_no").alias("first_line"))


def text_shards(lines: DataFrame, n: int, how: str = "chunk") -> DataFrame:
    """lines with shard: n runs of lines of a file (chunk) or line number modulo n (robin)."""
    if how == "robin":
        return lines.withColumn("shard", F.pmod("line_no", F.lit(n)).cast("int"))
    if how != "chunk":
        raise ValueError(f"chunk or robin, not {how}; sorted shards come from sorted_shards()")
    total = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    return lines.join(total, "file").withColumn("shard", F.floor(F.col("line_no") * n / F.col("_n")).cast("int")).drop("_n")


def sorted_shards(df: DataFrame, column: str, n: int, unique: bool = False) -> DataFrame:
    """df in n partitions by range of a column, each sorted; unique keeps one row a value."""
    df = df.dropDuplicates([column]) if unique else df
    return df.repartitionByRange(n, column).sortWithinPartitions(column)


def split_sizes(files: DataFrame, most: int) -> DataFrame:
    """files with the number of pieces of at most `most` bytes each goes in."""
    return files.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("length") / most)).cast("int"))


def xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, text) of .xz files, which Spark has no codec for: a file is one stream and one task by nature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1)):
                with lzma.open(io.BytesIO(data.as_py()), "rt", encoding="utf-8", errors="replace", newline="\n") as f:
                    part: list[str] = []
                    at = 0
                    for line in f:
                        part.append(line.rstrip("\n"))
                        if len(part) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part)], names=["file", "line_no", "text"])
                            at, part = at + len(part), []
                    if part:
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(at, at + len(part)), pa.int64()), pa.array(part)], names=["file", "line_no", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, line_no long, text string")


@dataclass(frozen=True)
class Corpus:
    """Where a corpus lies: a mined table, two sides, or one side; metadata beside two sides."""

    src: str | None = None
    tgt: str | None = None
    tsv: str | None = None
    metadata: str | None = None

    def __post_init__(self) -> None:
        if (self.tsv is None) == (self.src is None):
            raise ValueError("either tsv or src")
        if self.tsv and (self.tgt or self.metadata) or self.metadata and not self.tgt:
            raise ValueError("a mined table stands alone; metadata belongs to two sides")


def read_corpus(spark: SparkSession, c: Corpus) -> DataFrame:
    """(line_no, src[, tgt][, score][, metadata]) of a corpus; sides meet by line number."""
    one = lambda path, name: numbered_lines(spark, path).select("line_no", F.col("text").alias(name))
    if c.tsv:
        f = F.split("row", "\t", 3)
        return one(c.tsv, "row").select("line_no", f[1].alias("src"), f[2].alias("tgt"), f[0].cast("double").alias("score"))
    out = one(c.src, "src")
    for path, name in ((c.tgt, "tgt"), (c.metadata, "metadata")):
        out = out.join(one(path, name), "line_no") if path else out
    return out


def read_column(spark: SparkSession, spec: str, sep: str = "\t") -> DataFrame:
    """(line_no, value) of one column of a delimited file, file.tsv:name or file.tsv:3."""
    path, column = spec.rsplit(":", 1)
    lines = numbered_lines(spark, path)
    if column.isdigit():
        return lines.select("line_no", F.get(F.split("text", sep), F.lit(int(column))).alias("value"))
    header = lines.where("line_no = 0").select(F.split("text", sep).alias("h")).first().h
    return skipped(lines, 1).select((F.col("line_no") - 1).alias("line_no"), F.get(F.split("text", sep), F.lit(header.index(column))).alias("value"))


def read_positional(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Columns of a file without a header by position."""
    return spark.read.option("sep", sep).option("quote", "").csv(path, schema=", ".join(f"`{n}` string" for n in names))


def load_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(phrase): the different lines of a file, trimmed, without empty ones."""
    return spark.read.text(path).select(F.trim("value").alias("phrase")).where("phrase <> ''").distinct()


def media_fields(ref: Column) -> Column:
    """Struct (path, start, length, rate) of references path, path:start:length and path:start:length:rate; numbers null where absent."""
    num = lambda k: F.nullif(F.regexp_extract(ref, r":(\d+):(\d+)(?::(\d+))?$", k), F.lit("")).cast("long")
    return F.struct(F.regexp_replace(ref, r":\d+:\d+(?::\d+)?$", "").alias("path"), num(1).alias("start"), num(2).alias("length"), num(3).alias("rate"))


def typed_cell(c: Column) -> Column:
    """Struct (kind, number, path, text) of a cell that may be a number, a reference to audio or text."""
    number = c.try_cast("double")
    audio = c.rlike(r"(?i)\.(?:wav|mp3|flac|ogg|zip)(?::\d+:\d+(?::\d+)?)?$")
    kind = F.when(number.isNotNull(), "number").when(audio, "audio").otherwise("text")
    return F.struct(kind.alias("kind"), number.alias("number"), F.when(kind == "audio", c).alias("path"), F.when(kind == "text", c).alias("text"))


def concatenated(matrices: DataFrame) -> DataFrame:
    """(row, embedding) of the rows of several matrix files as one, in order of file and row."""
    sizes = matrices.groupBy("file").agg(F.count("*").alias("n"))  # a row a file
    starts = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return matrices.join(F.broadcast(starts), "file").select((F.col("start") + F.col("row")).alias("row"), "embedding")


def _by_lists(a: pa.ListArray, values: pa.Array) -> pa.Array:
    """The lists of a with other values."""
    return pa.ListArray.from_arrays(a.offsets, values, mask=a.is_null() if a.null_count else None)


def half_bits(values: Column) -> Column:
    """Numbers as the 16-bit patterns of half floats, for engines without them."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array) -> pa.Array:
        a = pa.concat_arrays([a])
        return _by_lists(a, pa.array(a.values.to_numpy(zero_copy_only=False).astype(np.float16).view(np.int16).astype(np.int32)))

    return run(values)


def from_half_bits(bits: Column) -> Column:
    @F.arrow_udf("array<float>")
    def run(a: pa.Array) -> pa.Array:
        a = pa.concat_arrays([a])
        return _by_lists(a, pa.array(a.values.to_numpy(zero_copy_only=False).astype(np.int16).view(np.float16).astype(np.float32)))

    return run(bits)


def output_name(shard: str, folder: str, suffix: str = "") -> str:
    """The output of an input file: its name in a folder, compression suffix dropped, with a suffix before its own."""
    name = re.sub(r"\.(?:gz|xz|bz2)$", "", shard.rstrip("/").rsplit("/", 1)[-1])
    stem, dot, kind = name.rpartition(".")
    return f"{folder.rstrip('/')}/{stem + suffix + dot + kind if dot else name + suffix}"


def write_ordered(df: DataFrame, path: str, order: list[str], text: str = "text", files: int = 1) -> None:
    """Lines of all shards in order: parts by range, each sorted, so that names in order give lines in order."""
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).select(text).write.text(path)


def write_shuffled_shards(df: DataFrame, path: str, n: int, key: str, seed: int = 0) -> None:
    """Rows dealt to n folders shard=k by seeded hash, each in seeded random order."""
    placed = df.withColumn("shard", sampling.shard_of(F.col(key), n, seed))
    placed.repartition(n, "shard").sortWithinPartitions("shard", F.xxhash64(key, F.lit(seed + 1))).write.partitionBy("shard").parquet(path)


def plain(value):
    """A value of dataclasses, enums and containers as JSON data."""
    if is_dataclass(value) and not isinstance(value, type):
        return {k: plain(v) for k, v in asdict(value).items()}
    if isinstance(value, Enum):
        return value.value
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple, set)) else value


def with_provenance(df: DataFrame, meta: dict, now: float | None = None) -> DataFrame:
    """df whose first column's metadata says how it was made and when, with what it said before nested below; Parquet keeps it."""
    first = df.schema[0]
    old = (first.metadata or {}).get("provenance")
    new = plain(meta) | {"saved_at": now or time.time()} | ({"previous": old} if old else {})
    return df.withMetadata(first.name, (first.metadata or {}) | {"provenance": new})


def plan_shards(files: DataFrame, target: int, order: str = "default", seed: int = 0) -> DataFrame:
    """files with shard: runs of about `target` bytes in order of path, size (increasing, decreasing) or seeded hash (random); a row a file."""
    by = {"default": ["path"], "random": [F.xxhash64("path", F.lit(seed)), "path"], "increasing": ["length", "path"], "decreasing": [F.desc("length"), "path"]}[order]
    before = F.coalesce(F.sum("length").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("shard", F.floor(before / target).cast("int"))


def wav_fields(content: Column) -> Column:
    """Struct (channels, rate, seconds) from the 44 header bytes of plain PCM audio files; null for other content."""
    number = lambda at, n: F.conv(F.hex(F.concat(*(F.substring(content, at + k, 1) for k in range(n - 1, -1, -1)))), 16, 10).cast("long")
    plain = (F.substring(content, 1, 4) == F.lit(b"RIFF")) & (F.substring(content, 37, 4) == F.lit(b"data"))
    return F.when(plain, F.struct(number(23, 2).alias("channels"), number(25, 4).alias("rate"), (number(41, 4) / number(29, 4)).alias("seconds")))
