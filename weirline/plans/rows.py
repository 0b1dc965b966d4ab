"""Queries of sources, sinks, sampling, dedup, nested arrays and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirline.functions import nested
from weirline.functions import text as X
from weirline.operators import dedup, intervals, sampling
from weirline.plans.registry import query
from weirline.plans.strings import KEY, PAIRS, pairs


@query("select cast(pmod as int) as shard, count(*) as n from (select l_orderkey % 7 as pmod from lineitem) group by 1")
def src_round_robin(t):
    """SRC-11, SRC-12: shard by position."""
    return t("lineitem").groupBy(sampling.round_robin(F.col("l_orderkey"), 7).alias("shard")).agg(F.count("*").alias("n"))


@query("select doc_id, ntile(7) over (order by doc_id) as chunk from documents")
def src_equal_chunks(t):
    """SRC-27: near-equal chunks, the first ones larger by one; positions come from counts of ranges, no task sees all rows."""
    d = sampling.positions(t("documents").select("doc_id"), "doc_id")
    return sampling.equal_chunks(d, 7).select("doc_id", "chunk")


@query("select doc_id, lang from documents order by doc_id limit 20")
def src_head(t):
    """SRC-04, SRC-09: the first rows by position."""
    return t("documents").orderBy("doc_id").limit(20).select("doc_id", "lang")


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def src_json_fields(t):
    """SRC-16, ARR-12, ARR-13: named keys of JSON rows."""
    return t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("select conv_id, turn, length(src) as n_src, length(tgt) as n_tgt from " + PAIRS)
def jn_positional_pairs(t):
    """SRC-20, JN-01, PRJ-02: positional join of two sides."""
    return pairs(t).select("conv_id", "turn", F.length("src").cast("long").alias("n_src"), F.length("tgt").cast("long").alias("n_tgt"))


@query("select vec_id, cast(len(embedding) as int) as dim from embeddings")
def src_embedding_rows(t):
    """SRC-30, SRC-33, ARR-08: vectors as rows and their lengths."""
    return t("embeddings").select("vec_id", F.size("embedding").alias("dim"))


@query("select vec_id, list_transform(embedding, lambda x: cast(floor(x::double * 1000) as int)) as v from embeddings where vec_id in (select doc_id from labels)")
def snk_embedding_subset(t):
    """SNK-07: the rows of a matrix that an id list names, in thousandths."""
    ids = t("labels").select(F.col("doc_id").alias("vec_id"))
    return t("embeddings").join(ids, "vec_id", "left_semi").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 1000).cast("int")).alias("v"))


@query(f"select min(doc_id) as doc_id, count(*) as n from (select doc_id, {KEY} as k from documents) group by k")
def set_exact_dedup(t):
    """SET-04, SET-05, SRT-02, WIN-01: one row a normalised text, pre-aggregated before the one exchange."""
    return t("documents").groupBy(X.dedup_key(F.col("text")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("k")


@query(f"select conv_id, turn from (select *, row_number() over (partition by src, tgt order by conv_id, turn) as r from {PAIRS}) where r = 1")
def set_pair_dedup(t):
    """SET-03, SET-07, JN-18: pairs once, the first stays."""
    return dedup.first_per_key(pairs(t), ["src", "tgt"], ["conv_id", "turn"]).select("conv_id", "turn")


@query(
    f"""with a as (select *, row_number() over (partition by src, tgt order by conv_id, turn) as r from {PAIRS}), b as (select *, row_number() over (partition by tgt order by conv_id, turn) as q from a where r = 1),
c as (select *, row_number() over (partition by src order by conv_id, turn) as p from b where q <= 1) select conv_id, turn from c where p <= 1"""
)
def flt_staged_dedup(t):
    """FLT-09: staged caps on targets and sources."""
    return dedup.staged(pairs(t), "src", "tgt", ["conv_id", "turn"], 1, 1).select("conv_id", "turn")


@query(
    f"""select conv_id, turn, rp = 1 as neither, rp = 1 and rs = 1 as by_src, rp = 1 and rt = 1 as by_tgt, rp = 1 and rs = 1 and rt = 1 as by_both from (select *, row_number() over (partition by src, tgt order by conv_id, turn) as rp,
row_number() over (partition by src order by conv_id, turn) as rs, row_number() over (partition by tgt order by conv_id, turn) as rt from {PAIRS})"""
)
def set_dedup_types(t):
    """SET-06: pair, source, target and both."""
    f = dedup.seen_flags(pairs(t), "src", "tgt", ["conv_id", "turn"])
    p, s, g = F.col("first_pair"), F.col("first_src"), F.col("first_tgt")
    return f.select("conv_id", "turn", p.alias("neither"), (p & s).alias("by_src"), (p & g).alias("by_tgt"), (p & s & g).alias("by_both"))


@query(f"select doc_id from documents where {KEY} not in (select {KEY} from benchmark)")
def jn_eval_anti_join(t):
    """JN-17: rows whose normalised text an evaluation set has go."""
    return dedup.without_seen(t("documents"), t("benchmark"), X.dedup_key(F.col("text"))).select("doc_id")


@query("select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_suppkey order by l_extendedprice desc, l_orderkey, l_linenumber) as r from lineitem) where r <= 3")
def srt_top_k_per_key(t):
    """SRT-04, SRT-12, VEC-09: the best rows of each key."""
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query(
    """with c as (select lang, count(*) as n from documents group by lang), p as (select *, pow(n / (select sum(n) from c), 0.2) as p from c)
select lang, n, cast(least(n, floor(p / (select sum(p) from p) * 500)) as bigint) as sample from p"""
)
def srt_temperature_sizes(t):
    """SRT-07: sample sizes smoothed by temperature."""
    counts = t("documents").groupBy("lang").agg(F.count("*").alias("n"))
    return sampling.temperature_sizes(counts, "lang", "n", 500, 5.0).withColumn("sample", F.col("sample").cast("long"))


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('0:' || doc_id), doc_id) as r from documents) where r <= 20")
def srt_hash_sample(t):
    """SRT-08: at most 20 rows a language, those first by seeded hash."""
    return sampling.sample_per_group(t("documents").select("doc_id", "lang"), "lang", "doc_id", 20)


@query("select cast(('0x' || substr(md5('7:' || doc_id), 1, 8))::bigint % 8 as int) as shard, count(*) as n from documents group by 1")
def snk_hash_shards(t):
    """SNK-10: rows of each shard by seeded hash."""
    return t("documents").groupBy(sampling.md5_shard(F.col("doc_id"), 8, 7).alias("shard")).agg(F.count("*").alias("n"))


@query("select o_orderkey, cast(floor((row_number() over (partition by o_custkey order by o_orderkey) - 1) / 4) as bigint) as batch from orders")
def srt_batches(t):
    """SRT-10, SRC-07: batches of four in order."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t("orders").select("o_orderkey", F.floor((r - 1) / 4).alias("batch"))


WORDS = "string_split(text, ' ')"


@query(f"select doc_id, unnest({WORDS}) as word, unnest(range(1, len({WORDS}) + 1)) as pos from documents")
def arr_parallel_explode(t):
    """ARR-01: parallel explode."""
    w = F.split("text", " ")
    df = t("documents").select("doc_id", w.alias("word"), F.sequence(F.lit(1).cast("long"), F.size(w).cast("long")).alias("pos"))
    return nested.explode_with_null(df, "word", "pos")


@query(f"select doc_id, unnest(range(0, cast(ceil(len({WORDS}) / 5) as bigint))) as k, list_slice({WORDS}, 1 + 5 * unnest(range(0, cast(ceil(len({WORDS}) / 5) as bigint))), 5 + 5 * unnest(range(0, cast(ceil(len({WORDS}) / 5) as bigint)))) as part from documents")
def arr_chunks(t):
    """ARR-02: chunks of at most five."""
    w = F.split("text", " ")
    return t("documents").select("doc_id", F.posexplode(nested.chunks(w, 5)).alias("k", "part")).withColumn("k", F.col("k").cast("long"))


@query(
    """with x as (select lang, doc_id, unnest(string_split(source, 'r')) as v, unnest(range(0, len(string_split(source, 'r')))) as k from documents), p as (select *, row_number() over (partition by lang order by doc_id, k) - 1 as pos from x)
select lang, cast(floor(pos / 7) as bigint) as pack, list(v order by pos) as items, list(doc_id order by pos) as rows from p group by lang, floor(pos / 7)"""
)
def arr_pack(t):
    """ARR-03: fixed packs across rows."""
    return nested.pack(t("documents").select("lang", "doc_id", F.split("source", "r").alias("v")), "v", "doc_id", 7, "lang")


@query("select vec_id, list_concat(embedding[1:2], embedding[5:6]) as v, [embedding[1], embedding[5]] as f, [label] as l from embeddings")
def arr_hstack_first(t):
    """ARR-05..07: concatenated lists, first of each, a scalar as a list."""
    a, b = F.slice("embedding", 1, 2), F.slice("embedding", 5, 2)
    return t("embeddings").select("vec_id", F.concat(a, b).alias("v"), nested.first_of_each(F.array(a, b)).alias("f"), F.array("label").alias("l"))


@query("select doc_id, coalesce(map {'en': 'English', 'de': 'German'}[lang], 'other') as name from documents")
def arr_dictionary(t):
    """ARR-16, STR-19: lookup with overrides."""
    m = F.create_map(*(F.lit(x) for x in ("en", "English", "de", "German")))
    return t("documents").select("doc_id", F.coalesce(F.try_element_at(m, F.col("lang")), F.lit("other")).alias("name"))


@query("select event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) as pause from events")
def win_pause(t):
    """WIN-02: pause since the row before."""
    us = F.expr("unix_micros(cast(ts as timestamp))")
    return t("events").select("event_id", "user_id", (us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("pause"))


ISLAND = "select *, sum(n) over (partition by user_id order by ts, event_id rows unbounded preceding) as island from (select *, case when event_type <> lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as n from events)"


@query(f"with i as ({ISLAND}) select user_id, cast(island as bigint) as island, min(event_type) as event_type, count(*) as n, round(sum(value), 4) as value from i group by user_id, island")
def win_islands(t):
    """WIN-03, WIN-13: runs of equal rows, collapsed."""
    gap = lambda w: F.col("event_type") != F.lag("event_type").over(w)
    i = intervals.islands(t("events"), "user_id", ["ts", "event_id"], gap)
    return i.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


FRAMES = "f as (select user_id as key, row_number() over (partition by user_id order by ts, event_id) - 1 as time, event_type as token, event_type[1:1] as label, coalesce(value, 0) as score from events), g as (select *, sum(n) over (partition by key order by time rows unbounded preceding) as segment from (select *, case when token <> lag(token) over (partition by key order by time) then 1 else 0 end as n from f)), s as (select key, segment, arg_min(label, time) as label, min(time) as start, max(time) + 1 as stop, avg(score) as score from g group by key, segment)"


def frames(t):
    """(key, time, token, label, score): each user's events as the frames of a recording."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return t("events").select(F.col("user_id").alias("key"), place.alias("time"), F.col("event_type").alias("token"), F.substring("event_type", 1, 1).alias("label"), F.coalesce("value", F.lit(0.0)).alias("score"))


@query(f"with {FRAMES} select key, cast(segment as bigint) as segment, label, cast(start as int) as start, cast(stop as int) as end, round(score, 6) as score from s")
def win_frame_segments(t):
    """WIN-13: runs of frames of one token merged, with their mean score."""
    s = intervals.frame_segments(frames(t), "key", "time", "token", "label", "score")
    return s.select("key", F.col("segment").cast("long").alias("segment"), "label", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.round("score", 6).alias("score"))


@query(
    f"""with {FRAMES}, w as (select *, coalesce(sum((label = 'e')::int) over (partition by key order by segment rows between unbounded preceding and 1 preceding), 0) as word from s),
a as (select key, unnest(range(0, 1 + count(*) filter (label = 'e'))) as word from s group by key)
select a.key, cast(a.word as bigint) as word, coalesce(string_agg(label, '' order by segment) filter (label <> 'e'), '') as text, round(coalesce(min(start) filter (label <> 'e') / 50, -1.0), 6) as start, round(coalesce(max(stop) filter (label <> 'e') / 50, -1.0), 6) as end
from a left join w using (key, word) group by a.key, a.word"""
)
def win_frame_words(t):
    """WIN-13: words of merged frames between separators, with their times at 50 frames a second."""
    s = intervals.frame_segments(frames(t), "key", "time", "token", "label", "score")
    return intervals.segment_words(s, "e", 50.0).select("key", F.col("word").cast("long").alias("word"), "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query("with w as (select conv_id, turn, role, lead(role) over (partition by conv_id order by turn) as b, lead(role, 2) over (partition by conv_id order by turn) as c from conversations) select role, b, c, count(*) as n from w where c is not null group by role, b, c")
def win_ngrams(t):
    """WIN-05: n-grams of consecutive rows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    g = t("conversations").select("role", F.lead("role").over(w).alias("b"), F.lead("role", 2).over(w).alias("c"))
    return g.where("c is not null").groupBy("role", "b", "c").agg(F.count("*").alias("n"))


@query("select o_orderkey, o_custkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as r from orders) where r = 1")
def tim_latest(t):
    """TIM-04, CNT-31: the latest row of each key."""
    return dedup.first_per_key(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "o_custkey")
