"""Queries that write one ordered file from many tasks and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.operators.rounds import shared_path
from weirline.plans.registry import query
from weirline.sources import matrix, single
from weirline.sources.files import numbered_lines


@query("select row_number() over (order by vec_id) - 1 as row, round(list_sum(embedding::double[]), 4) as total, len(embedding)::int as dim from embeddings")
def src_matrix_ranges(t):
    """SRC-30, SRC-46, SNK-06, ARR-08: vectors in order of id as one .npy of many tasks, read in byte ranges of a few rows."""
    e = t("embeddings").select("vec_id", "embedding")
    path = shared_path(e.sparkSession, ".npy")
    single.write_matrix(e, path, ["vec_id"], parts=8)
    back = matrix.read_matrix(e.sparkSession, path, range_bytes=1 << 18)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("row", F.round(total, 4).alias("total"), F.size("embedding").alias("dim"))


@query("select row_number() over (order by vec_id) - 1 as row from embeddings where vec_id % 3 = 0")
def snk_half_matrix(t):
    """SNK-07, SRC-46: a subset as bare half floats with their header beside them; the reader takes the row numbers without the numbers."""
    e = t("embeddings").where("vec_id % 3 = 0").select("vec_id", "embedding")
    path = shared_path(e.sparkSession, ".bin")
    single.write_matrix(e, path, ["vec_id"], dtype="<f2", header_beside=True, parts=8)
    return matrix.read_matrix(e.sparkSession, path, columns=["row"])


@query("with l as (select doc_id, unnest(string_split(regexp_replace(text, '[\\r\\f\\x0B]', ' ', 'g'), chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from documents) select row_number() over (order by doc_id, k) - 1 as line_no, md5(line) as h from l")
def snk_one_text_file(t):
    """SNK-05, SRC-28: lines of all documents in order as one file of many tasks, read back with their numbers."""
    lines = t("documents").select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "[\\r\\f\\x0B]", " "), "\n")).alias("k", "line"))
    path = shared_path(lines.sparkSession, ".txt")
    single.write_text(lines, path, ["doc_id", "k"], "line", parts=8)
    back = numbered_lines(lines.sparkSession, path)
    return back.select(F.col("line_no").cast("long").alias("line_no"), F.md5(F.col("text").cast("binary")).alias("h"))


@query(
    """with x as (select 'd' || lpad(cast(doc_id as varchar), 9, '0') as name, octet_length(encode(coalesce(text, ''))) as length, md5(coalesce(text, '')) as h from documents)
select name, cast(sum(30 + 10 + length) over (order by name) - length as bigint) as first_byte, length, h from x"""
)
def snk_archive(t):
    """SNK-12: texts as the items of one archive; its manifest's offset and length give each item's bytes."""
    d = t("documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0")).alias("name"), F.col("text").alias("data"))
    path = shared_path(d.sparkSession, ".zip")
    manifest = single.write_archive(d, path, parts=8)
    items = single.read_items(manifest, path).select("name", F.md5("data").alias("h"))
    return manifest.join(items, "name").select("name", "first_byte", "length", "h")


@query(
    """with x as (select 'd' || lpad(cast(doc_id % 400 as varchar), 9, '0') as name, arg_min(text, doc_id) as text from documents where doc_id % 400 < 300 or doc_id >= 400 group by 1)
select name, cast(sum(30 + 10 + octet_length(encode(text))) over (order by name) - octet_length(encode(text)) as bigint) as first_byte, octet_length(encode(text)) as length, md5(text) as h from x"""
)
def snk_merged_archive(t):
    """SNK-13: two archives merged, each name once, the first archive's item first."""
    d = t("documents").where("doc_id % 400 < 300 or doc_id >= 400").select("doc_id", F.concat(F.lit("d"), F.lpad((F.col("doc_id") % 400).cast("string"), 9, "0")).alias("name"), F.col("text").alias("data"))
    spark, made = d.sparkSession, []
    for part in (d.where("doc_id < 400"), d.where("doc_id >= 400").groupBy("name").agg(F.min_by("data", "doc_id").alias("data"))):
        path = shared_path(spark, ".zip")
        made.append((single.write_archive(part, path, parts=4), path))
    path = shared_path(spark, ".zip")
    manifest = single.merged(made, path, parts=8)
    items = single.read_items(manifest, path).select("name", F.md5("data").alias("h"))
    return manifest.join(items, "name").select("name", "first_byte", "length", "h")
