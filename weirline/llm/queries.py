"""The queries of the llm operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirline.llm import centroids, decontaminate, language, linededup, ngramjoin, pieces, pii, quality, repair, secrets, sharding, simhash, tokencount


STOP_COUNT = " ".join(f"when '{k}' then len(list_filter(words, lambda w: lower(w) in ({', '.join(repr(w) for w in v.split())})))" for k, v in quality.STOP_WORDS.items())

OP4_SQL = f"""
with d as (
  select doc_id, lang, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines
  from documents
), g as (
  select doc_id, i, array_to_string(words[i:i + 7], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from d)
), twice as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1
), covered as (
  select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(0, 8)) as k from twice) group by doc_id
), m as (
  select d.doc_id, cast(len(words) as bigint) as n_words,
    cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(case lang {STOP_COUNT} end as bigint) as n_stop_words,
    cast(len(lines) as bigint) as n_lines,
    cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
  from d left join covered using (doc_id)
), b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
  and coalesce(word_chars / nullif(n_words, 0) between 2.0 and 12.0, true)
  and coalesce(n_symbols / nullif(n_words, 0) <= 0.1, true)
  and coalesce(n_stop_words / nullif(n_words, 0) >= 0.03, true)
  and coalesce(n_dup_lines / nullif(n_lines, 0) <= 0.5, true) as kept
from b
"""


def _op11_sql() -> str:
    """Lloyd rounds over all distances: c0 to c5 are the centroids, n0 to n5 each vector's nearest."""
    kept = """k as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as (
  select row_number() over (order by sha256('2:' || vec_id), v) - 1 as c, v from k order by sha256('2:' || vec_id), v limit 40
)"""
    parts = [kept]
    for i in range(6):
        parts.append(
            f"""n{i} as (
  select r, vec_id, any_value(v) as v, min(e) as e from (
    select k.r, vec_id, k.v, {{'d': cast(list_sum(list_transform(list_zip(k.v, c{i}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint), 'c': c}} as e
    from (select row_number() over () as r, * from k) as k, c{i}
  ) group by r, vec_id
)"""
        )
        if i < 5:
            parts.append(
                f"""m{i} as (
  select c, list(cast(floor(s / n) as bigint) order by j) as v from (
    select e.c as c, j, cast(sum(v[j]) as double) as s, count(*) as n from (select e, v, unnest(range(1, 65)) as j from n{i}) group by e.c, j
  ) group by c
), c{i + 1} as (select c, coalesce(m{i}.v, c{i}.v) as v from c{i} left join m{i} using (c))"""
            )
    return "with " + ", ".join(parts) + """
select vec_id, cast(n5.e.c as integer) as cluster, n5.e.d as distance,
  cast(sum(n5.e.d) over (partition by n5.e.c) as bigint) as cluster_inertia, cast(sum(n5.e.d) over () as bigint) as inertia,
  sha256(array_to_string(c5.v, ',')) as centroid_sha256
from n5 join c5 on n5.e.c = c5.c
"""


OP13_SQL = """
with recursive w as materialized (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words
  from documents
), s as materialized (
  select r, doc_id, list_distinct(list_transform(range(1, greatest(len(words) - 3, case when len(words) > 0 then 1 else 0 end) + 1), lambda i: array_to_string(words[i:i + 3], ' '))) as grams from w
), g as materialized (
  select r, unnest(grams) as gram from s
), f as materialized (
  select gram, count(*) as c from g group by gram having c > 1
), o as (
  select a.r as a, b.r as b, count(*) as shared
  from (select * from g semi join f using (gram)) as a join (select * from g semi join f using (gram)) as b on a.gram = b.gram and a.r < b.r
  group by 1, 2
), e as (
  select o.a, o.b from o join s as x on o.a = x.r join s as y on o.b = y.r where 100 * shared >= 85 * (len(x.grams) + len(y.grams) - shared)
), n as (select a, b from e union all select b, a from e), walk as (
  select r as a, r as b from s union select walk.a, n.b from walk join n on walk.b = n.a
)
select s.doc_id, cast(len(s.grams) as bigint) as n_shingles, m.c as component_id
from s join (select walk.a as a, min(t.doc_id) as c from walk join s as t on walk.b = t.r group by walk.a) as m on m.a = s.r
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumnRenamed("id", "doc_id")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality.judged(documents(spark, sf_dir), keep=["doc_id"])
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(documents(spark, sf_dir))
    return s.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    crc = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 5, F.lit(0))
    model = language.fit(docs.where((crc("doc_id") != 0) & F.col("lang").isNotNull()))
    found = language.predict(docs, model)
    return found.select(F.col("id").alias("doc_id"), (crc("id") == 0).alias("held_out"), F.col("lang").alias("lang_pred"), "score", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(*centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("id", "vec_id")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every = given.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repair.digests(repair.repair(repair.damaged(given)))
    both = every.join(found, every.conv_id.eqNullSafe(found.id), "left")
    totals = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in repair.TOTALS)
    return both.select("conv_id", *totals, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramjoin.join(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality": OP4_SQL, "op11_centroids": _op11_sql(), "op13_ngram_join": OP13_SQL}
