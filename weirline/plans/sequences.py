"""Queries of segments, state machines and pluggable models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirline.operators import batching as B
from weirline.operators import models
from weirline.operators import sequences as S
from weirline.plans.registry import query

BY_USER = "partition by user_id order by ts, event_id"


@query("select event_id, round(value * 1000 / 16, 4) as ms, value > 1 and value * 1000 > 5000 as keep from events where value is not null")
def tim_durations(t):
    """TIM-01, FLT-16: durations from frames and thresholds."""
    return t("events").where("value is not null").select("event_id", F.round(F.col("value") * 1000 / 16, 4).alias("ms"), ((F.col("value") > 1) & (F.col("value") * 1000 > 5000)).alias("keep"))


@query("select event_id, round(exp(value / 100) / sum(exp(value / 100)) over (partition by user_id), 6) as p from events where value is not null")
def vec_softmax(t):
    """VEC-22: softmax of scores within a group."""
    e = F.exp(F.col("value") / 100)
    return t("events").where("value is not null").select("event_id", F.round(e / F.sum(e).over(Window.partitionBy("user_id")), 6).alias("p"))


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: abs(x::double))), 4) as l1, round(10 * log10(list_dot_product(embedding::double[], embedding::double[]) / list_sum(list_transform(embedding, lambda x: pow(x::double - 0.5, 2)))), 4) as snr from embeddings")
def vec_snr(t):
    """VEC-21: sums over a signal and its difference."""
    s = lambda f: F.aggregate(F.transform("embedding", lambda x: f(x.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return t("embeddings").select("vec_id", F.round(s(F.abs), 4).alias("l1"), F.round(10 * F.log10(s(lambda x: x * x) / s(lambda x: F.pow(x - 0.5, F.lit(2)))), 4).alias("snr"))


@query("select doc_id, 'd' as kind from documents union all select item_id, 'b' from benchmark")
def set_union(t):
    """SET-01: union of tables of one schema."""
    return t("documents").select("doc_id", F.lit("d").alias("kind")).unionByName(t("benchmark").select(F.col("item_id").alias("doc_id"), F.lit("b").alias("kind")))


@query("select lang, min(doc_id) as first_doc, arg_min(source, doc_id) as first_source from documents group by lang")
def cnt_first_row(t):
    """CNT-31: the first row of each group by partial aggregates."""
    return t("documents").groupBy("lang").agg(F.min("doc_id").alias("first_doc"), F.min_by("source", "doc_id").alias("first_source"))


@query(f"select event_id, coalesce(event_type <> lag(event_type) over ({BY_USER}), true) as boundary from events")
def win_boundaries(t):
    """WIN-02: boundary flags against the row before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").select("event_id", F.coalesce(F.col("event_type") != F.lag("event_type").over(w), F.lit(True)).alias("boundary"))


FIRST = "select *, row_number() over (partition by user_id order by s, event_id) as r from (select user_id, event_id, epoch(ts)::double as s, epoch(ts) + value * 60 as e, value as score from events where value > 0)"


@query(
    f"""with recursive x as ({FIRST}), k as (select user_id, r, s, e, score, event_id, 1 as slot from x where r = 1 union all
  select x.user_id, x.r, case when o > 0.1 and k.score >= x.score then k.s else x.s end, case when o > 0.1 and k.score >= x.score then k.e else x.e end, case when o > 0.1 and k.score >= x.score then k.score else x.score end,
    case when o > 0.1 and k.score >= x.score then k.event_id else x.event_id end, case when o > 0.1 then k.slot else k.slot + 1 end
  from k, lateral (select x.*, greatest(0, least(x.e, k.e) - greatest(x.s, k.s)) / greatest(x.e - x.s, k.e - k.s) as o from x where x.user_id = k.user_id and x.r = k.r + 1) x)
select user_id as key, arg_max(event_id, r) as event_id from k group by user_id, slot"""
)
def win_greedy_suppression(t):
    """WIN-09, JN-15: in order of start, a segment of a user that overlaps the last one kept stays only in its place and if it scores higher."""
    e = t("events").where("value > 0").selectExpr("user_id as key", "event_id", "unix_micros(cast(ts as timestamp)) / 1000000.0D as s0", "value as score").selectExpr("key", "event_id", "cast(s0 as double) as start", "cast(s0 as double) + score * 60 as end", "score")
    return S.suppress_groups(e, "key").select("key", "event_id")


@query(
    """with recursive x as (select user_id, event_id, coalesce(value, 0) as d, event_type = 'error' as fresh, event_type in ('click', 'view') as may, row_number() over (partition by user_id order by ts, event_id) as r from events),
k as (select user_id, r, event_id, 0::double as total, 0 as segment from x where r = 1 union all
  select x.user_id, x.r, x.event_id, case when k.total + x.d >= 120 and x.may then 0 else k.total + x.d end, k.segment + case when x.fresh or (k.total + x.d >= 120 and x.may) then 1 else 0 end from k join x on x.user_id = k.user_id and x.r = k.r + 1)
select event_id, user_id, segment from k"""
)
def win_capped_segments(t):
    """WIN-04: segments from boundary flags and a duration cap that acts at split points."""

    kinds = B.capped_ends("value", lambda x: x["event_type"] == "error", lambda x: x["event_type"].isin("click", "view"), 120.0)
    e = t("events").select("event_id", "user_id", "ts", "value", "event_type")
    return B.numbered_runs(e, ["user_id"], ["ts", "event_id"], kinds, "segment").select("event_id", "user_id", "segment")


@query(
    """with recursive x as (select user_id, coalesce(value, 0) / 100 as p, row_number() over (partition by user_id order by ts, event_id) as r, count(*) over (partition by user_id) as n from events),
k as (select user_id, r, n, case when p >= 0.5 then 0 end as start, cast(null as bigint) as quiet, cast(null as bigint) as s, cast(null as bigint) as e from x where r = 1 union all
  select z.user_id, z.r, z.n, case when ends then null when loud and start is null then z.r * 10 - 10 else start end, case when ends then null else q end, case when ends and q - start > 10 then start end, case when ends and q - start > 10 then q end
  from (select y.*, start is not null and low and r * 10 - 10 - q >= 20 as ends from (select x.user_id, x.r, x.n, k.start, x.p >= 0.5 as loud, x.p < 0.35 as low,
    case when x.p >= 0.5 or k.start is null then null when x.p < 0.35 then coalesce(k.quiet, x.r * 10 - 10) else k.quiet end as q from k join x on x.user_id = k.user_id and x.r = k.r + 1) y) z),
f as (select user_id, n * 10 as total, s, e from k where s is not null union all select user_id, n * 10, start, n * 10 from k where r = n and start is not null and n * 10 - start > 10),
g as (select *, s - lag(e) over w as before, lead(s) over w - e as after from f window w as (partition by user_id order by s))
select user_id, cast(case when before is null then greatest(0, s - 4) when before < 8 then greatest(0, s - before // 2) else s end as int) as first,
  cast(case when after is null then least(total, e + 4) when after < 8 then e + after // 2 else e + 4 end as int) as last from g"""
)
def win_hysteresis(t):
    """WIN-10: spans over a threshold with hysteresis, padded, in each user's events (windows of ten samples): one fold over the ordered probabilities."""
    probs = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.coalesce("value", F.lit(0.0)).alias("v")))), lambda x: x["v"] / 100)
    spans = S.speech_spans(F.col("probs"), 0.5, None, 10, 10, 20, 4)
    each = t("events").groupBy("user_id").agg(probs.alias("probs")).select("user_id", F.explode(spans).alias("s"))
    return each.select("user_id", F.col("s.start").cast("int").alias("first"), F.col("s.end").cast("int").alias("last"))


@query()
def win_divide(t):
    """WIN-11: divide and conquer on the probabilities of each user's frames."""
    import pandas as pd

    def spans(g):
        found = S.divide(g["value"].fillna(0.0).to_numpy() / 200, 20, 3, 0.1)
        return pd.DataFrame({"user_id": g["user_id"].iloc[:1].repeat(len(found)).to_numpy(), "first": [a for a, _ in found], "last": [b for _, b in found]})

    return S.per_group(t("events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], spans, "user_id long, first int, last int")


@query(
    f"""with x as ({FIRST}), g as (select *, coalesce(s - lag(e) over (partition by user_id order by r) > 20000, false)::int as far from x), n as (select *, sum(far) over (partition by user_id order by r) as run from g)
select a.user_id, a.event_id as first, b.event_id as last from n a join n b on a.user_id = b.user_id and a.run = b.run and b.r >= a.r where b.e - a.s > 3000 and b.e - a.s < 40000"""
)
def win_candidate_spans(t):
    """WIN-12: spans from each segment of a user to those that follow without a wide gap, under length limits; a join inside runs of close segments."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    e = t("events").where("value > 0").selectExpr("user_id", "event_id", "unix_micros(cast(ts as timestamp)) / 1000000.0D as s0", "value").selectExpr("user_id", "event_id", "cast(s0 as double) as s", "cast(s0 as double) + value * 60 as e")
    e = e.withColumn("far", F.coalesce(F.col("s") - F.lag("e").over(w) > 20000, F.lit(False)).cast("int")).withColumn("run", F.sum("far").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cell = F.floor(F.col("s") / 40000)  # ends lie within 40000 of the start: the next cell at most
    a = e.select("user_id", "run", F.col("event_id").alias("first"), F.col("s").alias("a_s"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    b = e.select("user_id", "run", F.col("event_id").alias("last"), F.col("s").alias("b_s"), F.col("e").alias("b_e"), cell.alias("cell"))
    met = a.join(b, ["user_id", "run", "cell"]).where("b_s > a_s or (b_s = a_s and last >= first)").where("b_e - a_s > 3000 and b_e - a_s < 40000")
    return met.select("user_id", "first", "last")


@query(
    """with recursive x as (select doc_id, source || ':' || (doc_id % 64) as part, n_chars, row_number() over (partition by source, doc_id % 64 order by n_chars, doc_id) as r from documents),
k as (select part, r, doc_id, n_chars, 0 as batch, 1 as first from x where r = 1 union all
  select x.part, x.r, x.doc_id, x.n_chars, k.batch + cut, case when cut = 1 then x.r else k.first end from k, lateral (select x.*, case when x.n_chars * (x.r - k.first + 1) > 20000 then 1 else 0 end as cut from x where x.part = k.part and x.r = k.r + 1) x)
select doc_id, part, batch from k"""
)
def src_padded_batches(t):
    """SRC-32, SRT-05: batches by length within a padded size, in 64 parts of each source so that none is gathered whole."""

    part = F.concat_ws(":", "source", (F.col("doc_id") % 64).cast("string"))
    d = t("documents").select("doc_id", part.alias("part"), "n_chars")
    return B.numbered_runs(d, ["part"], ["n_chars", "doc_id"], B.padded_ends("n_chars", 20_000), "batch").select("doc_id", "part", "batch")


EPOCH = """d as (select doc_id, coalesce(length(text), 0) as n, doc_id // 64 as f, md5('7:' || doc_id) as h from documents),
fr as (select f, ((row_number() over (order by f) - 1) * 2) // count(*) over () as rank from (select distinct f from d)),
st as (select f, rank, (row_number() over (partition by rank order by md5('7:' || f), f) - 1) // 3 as step from fr),
l as (select rank, step, list_sort(list(n)) as l, count(*) - 1 as k from d join st using (f) group by rank, step),
q as (select rank, step, greatest(2, (l[k // 1000 + 1] * (1000 - k % 1000) + coalesce(l[k // 1000 + 2], 0) * (k % 1000)) // 1000)::bigint as spread from l),
g as (select doc_id, n, h, rank, step, spread from d join st using (f) join q using (rank, step)),
o as (select *, row_number() over (partition by rank, step order by m, h, doc_id) - 1 as i, count(*) over (partition by rank, step) as c from (select *, n + ('0x' || h[1:8])::bigint % spread as m from g))"""


@query(
    f"""with recursive {EPOCH},
k as (select rank, step, i, m, 0::bigint as start, false as cut from o where i = 0 union all
  select o.rank, o.step, o.i, o.m, case when o.m * (o.i - k.start) > 20000 then o.i - 1 else k.start end, o.m * (o.i - k.start) > 20000 from k join o on o.rank = k.rank and o.step = k.step and o.i = k.i + 1),
cuts as (select rank, step, i - 1 as at from k where cut union select rank, step, 0 from o where i = 0),
b as (select o.rank, o.step, o.doc_id, o.i, max(cuts.at) as start from o join cuts on cuts.rank = o.rank and cuts.step = o.step and cuts.at <= o.i group by all),
gone as (select k.rank, k.step, k.start from k join o on o.rank = k.rank and o.step = k.step and o.i = k.i where o.i = o.c - 1 and o.m > 20000),
kept as (select * from b where (rank, step, start) not in (select (rank, step, start) from gone)),
sized as (select rank, step, start from kept group by all having count(*) >= 2)
select doc_id, rank::int as rank, step::int as step, (dense_rank() over (partition by rank, step order by md5('7:' || start), start) - 1)::int as batch, (i - start)::int as at from kept join sized using (rank, step, start)"""
)
def src_epoch_tokens(t):
    """SRC-31, SRC-32, SRC-33, SRT-05: an epoch of two ranks in batches of at most about 20,000 padded characters, two documents at least a batch."""
    d = t("documents").select("doc_id", "text", F.floor(F.col("doc_id") / 64).alias("fragment"))
    out = B.epoch(d, "fragment", "doc_id", max_tokens=20_000, length="text", min_rows=2, ranks=2, together=3, seed=7)
    return out.select("doc_id", "rank", "step", "batch", "at")


@query(
    f"with {EPOCH}, b as (select *, (i // 16) * 16 as start from o) select doc_id, rank::int as rank, step::int as step, (dense_rank() over (partition by rank, step order by md5('7:' || start)) - 1)::int as batch, (i - start)::int as at from b where rank = 1"
)
def src_epoch_rows(t):
    """SRC-31, SRT-05: the second rank's epoch in batches of sixteen rows of near lengths."""
    d = t("documents").select("doc_id", "text", F.floor(F.col("doc_id") / 64).alias("fragment"))
    out = B.epoch(d, "fragment", "doc_id", batch_size=16, length="text", rank=1, ranks=2, together=3, seed=7)
    return out.select("doc_id", "rank", "step", "batch", "at")


@query()
def udf_hash_embeddings(t):
    """UDF-01, UDF-09, UDF-10: a pluggable encoder over distinct texts, joined back."""
    df = t("conversations").select("conv_id", "turn", "text")
    out = models.map_distinct(df, "text", lambda d: models.embed(d, "text", models.HashEncoder))
    return out.select("conv_id", "turn", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


SPANS = "(select event_id as id, user_id, epoch(ts) as s, epoch(ts) + value as e from events where value > 0)"


@query(f"select a.user_id, a.id as a, b.id as b from {SPANS} a join {SPANS} b on a.user_id = b.user_id and a.id <> b.id and a.s <= b.s and a.e >= b.e and floor(b.s / 3600) between floor(a.s / 3600) and floor(a.e / 3600)")
def jn_interval_contains(t):
    """JN-08: intervals of a key that hold another: the outer goes to every bucket it touches, the inner to its start's."""
    ev = t("events").where("value > 0").selectExpr("user_id", "event_id as id", "unix_micros(cast(ts as timestamp)) / 1000000.0D as s0", "value").selectExpr("user_id", "id", "cast(s0 as double) as s", "cast(s0 as double) + value as e")
    outer = ev.select("user_id", F.col("id").alias("a"), F.col("s").alias("a_s"), F.col("e").alias("a_e"), F.explode(F.sequence(F.floor(F.col("s") / 3600), F.floor(F.col("e") / 3600))).alias("k"))
    inner = ev.select("user_id", F.col("id").alias("b"), F.col("s").alias("b_s"), F.col("e").alias("b_e"), F.floor(F.col("s") / 3600).alias("k"))
    return outer.join(inner, ["user_id", "k"]).where("a <> b and a_s <= b_s and a_e >= b_e").select("user_id", "a", "b")


@query("select conv_id, string_agg(cast(turn as varchar) || '-' || role, ' ' order by turn) as edges, cast(count(*) as int) as n from conversations group by conv_id")
def str_edge_text(t):
    """STR-34: edges written to text and read again."""
    made = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws("-", x["turn"].cast("string"), x["role"])), " ").alias("edges"))
    return made.withColumn("n", F.size(F.transform(F.split("edges", " "), lambda x: F.split(x, "-"))))


@query("select doc_id, cast(coalesce(list_position(string_split(text, ' '), 'the'), 0) as bigint) as first_the, len(list_filter(string_split(text, ' '), lambda w: w = 'the')) as n_the from documents")
def str_find_word(t):
    """STR-37: places of a word in a text."""
    w = F.split("text", " ")
    return t("documents").select("doc_id", F.array_position(w, "the").alias("first_the"), F.size(F.filter(w, lambda x: x == "the")).cast("long").alias("n_the"))


@query("with s as (select user_id, event_type, sum(value) as v, count(*) as n from events group by all), u as (select event_type, avg(v / n) as macro, sum(v) / sum(n) as micro from s group by event_type) select event_type, round(macro, 6) as macro, round(micro, 6) as micro from u")
def cnt_micro_macro(t):
    """CNT-10: weighted and unweighted means of groups."""
    s = t("events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    return s.groupBy("event_type").agg(F.round(F.avg(F.col("v") / F.col("n")), 6).alias("macro"), F.round(F.sum("v") / F.sum("n"), 6).alias("micro"))
