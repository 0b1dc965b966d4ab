"""Queries of sentence-pair metrics: edges, contribution matrices, BLEU, pauses, speech units, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import alignment as A
from weirline.operators import ranks, scoring
from weirline.plans.registry import query
from weirline.plans.strings import PAIRS, pairs

W = "list_filter(string_split_regex({}, '\\s+'), lambda w: w <> '')"
PAIR_WORDS = f"(select conv_id, turn, {W.format('src')} as a, {W.format('tgt')} as b from {PAIRS})"


def words(c: str):
    return F.filter(F.split(c, "\\s+"), lambda w: w != "")


def word_pairs(t):
    return pairs(t).select("conv_id", "turn", words("src").alias("a"), words("tgt").alias("b"))


@query("with e as (select event_type, avg(case when value > 50 then 1.0 else 0.0 end) as p, avg(case when event_id % 2 = 0 then 1.0 else 0.0 end) as r from events group by event_type) select event_type, round(p * r * 2 / greatest(p + r, 1e-10), 6) as f1, round(least(p, r) / greatest(p, r), 6) as ratio from e")
def cnt_f1(t):
    """CNT-11, VEC-19: F1 of two shares, and the shorter over the longer."""
    e = t("events").groupBy("event_type").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("p"), F.avg((F.col("event_id") % 2 == 0).cast("double")).alias("r"))
    return e.select("event_type", F.round(A.f1(F.col("p"), F.col("r")), 6).alias("f1"), F.round(A.short_long_ratio(F.col("p"), F.col("r")), 6).alias("ratio"))


GRID = "(select conv_id, turn, i, i * len(b) // len(a) as j, i % 3 <> 2 as sure from (select *, unnest(range(0, len(a))) as i from {}) where len(a) > 0 and len(b) > 0)".format(PAIR_WORDS)
EDGE_TEXT = "array_join(transform(sequence(0, size(a) - 1), i -> concat(i, if(i % 3 = 2, 'p', '-'), i * size(b) div size(a))), ' ')"


def edge_rows(t):
    """Pairs with edge text: word i joined to its proportional place, every third one only possible."""
    return word_pairs(t).where("size(a) > 0 and size(b) > 0").withColumn("edges", F.expr(EDGE_TEXT))


@query(f"select conv_id, turn, count(*) as n, count(*) filter (sure) as n_sure, sum(i * 31 + j) as mix, sum((i - 1) * 31 + j - 1) as mix_one from {GRID} group by conv_id, turn")
def str_edges(t):
    """STR-34, SET-08: sure and possible edges read from text, zero- and one-based, reversed."""
    e = edge_rows(t).select("conv_id", "turn", A.edges(F.col("edges")).alias("e"), A.edges(F.col("edges"), one_based=True, reverse=True).alias("r"))
    add = lambda c, f: F.aggregate(c, F.lit(0).cast("long"), f)
    return e.select("conv_id", "turn", F.size("e").cast("long").alias("n"), F.size(F.filter("e", lambda x: x["sure"])).cast("long").alias("n_sure"), add("e", lambda s, x: s + x["i"] * 31 + x["j"]).alias("mix"), add("r", lambda s, x: s + x["j"] * 31 + x["i"]).alias("mix_one"))


@query(
    f"""with g as (select *, i % 2 = 0 as found from {GRID}), c as (select conv_id, turn, count(*) filter (found) as n, count(*) filter (sure) as s, count(*) filter (found and sure) as b from g group by all)
select conv_id, turn, round(n / nullif(n, 0), 6) as precision, round(b / nullif(s, 0), 6) as recall, round(1 - (b + n) / nullif(n + s, 0), 6) as aer from c"""
)
def set_alignment_error(t):
    """CNT-12, SET-08: precision, recall and error rate against sure and possible edges."""
    e = edge_rows(t).select("conv_id", "turn", A.edges(F.col("edges")).alias("e"))
    bare = lambda c: F.transform(c, lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j")))
    s = A.edge_scores(bare(F.filter("e", lambda x: x["i"] % 2 == 0)), bare(F.filter("e", lambda x: x["sure"])), bare(F.col("e")))
    return e.select("conv_id", "turn", *(F.round(s[k], 6).alias(k) for k in ("precision", "recall", "aer")))


@query(
    f"""with g as {GRID}, w as (select conv_id, turn, a, b from {PAIR_WORDS}), k as (select g.*, (i - (w.n / 2 + 0.5)) * (j - (w.m / 2 + 0.5)) > 0 as keeps from g join (select conv_id, turn, len(a) // 2 * 1.0 * 2 as n, len(b) // 2 * 1.0 * 2 as m from w) w using (conv_id, turn))
select conv_id, turn, round(sum(case when keeps then case when sure then 1 else 0.1 end else 0 end) / sum(case when sure then 1 else 0.1 end), 6) as ratio from k group by conv_id, turn"""
)
def vec_noncross(t):
    """VEC-19: share of edges that don't cross the edge between the middles of both sides, weak ones at a tenth."""
    e = edge_rows(t).select("conv_id", "turn", F.floor(F.size("a") / 2).alias("i"), F.floor(F.size("b") / 2).alias("j"), A.edges(F.col("edges")).alias("e"))
    r = A.noncross_ratio(F.col("i"), F.col("j"), F.filter("e", lambda x: x["sure"]), F.filter("e", lambda x: ~x["sure"]))
    return e.select("conv_id", "turn", F.round(r, 6).alias("ratio"))


@query(f"select conv_id, turn, list_sort(list(distinct j)) as places from (select g.*, w.a[g.i + 1] as word from {GRID} g join {PAIR_WORDS} w using (conv_id, turn)) where length(word) > 7 group by conv_id, turn")
def jn_flagged_words(t):
    """JN-12, TOX-06: places of flagged words, here those over seven letters, and of the words they are aligned with."""
    e = edge_rows(t).select("conv_id", "turn", F.filter(F.transform("a", lambda w, i: F.when(F.length(w) > 7, i)), lambda x: x.isNotNull()).alias("flags"), A.edges(F.col("edges")).alias("e"))
    return e.where("size(flags) > 0").select("conv_id", "turn", F.transform(A.flagged_on_other_side(F.col("flags"), F.col("e")), lambda x: x.cast("long")).alias("places"))


@query(
    """with c as (select conv_id, turn, unnest(string_split(text, '')) as c, unnest(range(0, len(string_split(text, '')))) as p from conversations),
w as (select *, regexp_matches(c, '\\s') as gap, sum(case when regexp_matches(c, '\\s') then 1 else 0 end) over (partition by conv_id, turn order by p) as g from c)
select conv_id, turn, min(p) as s, max(p) + 1 as e, round(max(((p * 7) % 13) / 13), 6) as score from w where not gap group by conv_id, turn, g"""
)
def jn_token_spans(t):
    """JN-13, STR-38: words of a text with character offsets, and the highest score of the characters in each."""
    w = t("conversations").select("conv_id", "turn", F.explode(A.word_starts(F.col("text"))).alias("w")).select("conv_id", "turn", F.col("w.s").cast("long").alias("s"), F.col("w.e").cast("long").alias("e"))
    score = F.array_max(F.transform(F.sequence(F.col("s"), F.col("e") - 1), lambda p: ((p * 7) % 13) / 13))
    return w.withColumn("score", F.round(score, 6))


@query(f"select conv_id, turn, array_to_string(list_transform(a, lambda w: w), ' ') as text, len(a) as n from {PAIR_WORDS}")
def str_merge_subtokens(t):
    """STR-39: sub-tokens of at most three letters merged to words at the mark."""
    cut = lambda w: F.regexp_extract_all(F.concat(F.lit("▁"), w), F.lit("(?s).{1,3}"), F.lit(0))
    merged = A.merged_tokens(F.flatten(F.transform("a", cut)))
    return word_pairs(t).select("conv_id", "turn", F.array_join(merged, " ").alias("text"), F.size(merged).cast("long").alias("n"))


@query(
    f"""with w as (select conv_id, turn, unnest(a) as w, unnest(range(0, len(a))) as k from {PAIR_WORDS}),
m as (select conv_id, turn, k, (case when k % 5 = 0 or k % 5 = 1 then '*' || w || '*' else w end) || (case when (k % 4) / 8 > 0.1 then ' [pause x ' || printf('%.2f', (k % 4) / 8) || ']' else '' end) as w from w)
select conv_id, turn, replace(string_agg(w, ' ' order by k), '* *', ' ') as text from m group by conv_id, turn"""
)
def str_markup(t):
    """STR-40: pauses and emphasis written into a text."""
    at = lambda f: F.transform("a", lambda _, k: f(k))
    return word_pairs(t).where("size(a) > 0").select("conv_id", "turn", A.marked_up(F.col("a"), at(lambda k: (k % 4) / 8), at(lambda k: F.when((k % 5).isin(0, 1), 1.0).otherwise(0.0))).alias("text"))


P = "list_transform(embedding, lambda x: abs(x::double) / list_sum(list_transform(embedding, lambda y: abs(y::double))))"


@query(
    f"""with p as (select vec_id, {P} as p, list_reverse({P}) as q from embeddings), d as (select vec_id, unnest(p) as p, unnest(q) as q, unnest(range(0, 64)) as k from p), r as (select *, sum(p - q) over (partition by vec_id order by k) as run from d)
select vec_id, round(0.5 * sum(abs(p - 1 / 64)), 6) as to_uniform, round(sum(abs(run)), 6) as mover from r group by vec_id"""
)
def vec_wasserstein(t):
    """VEC-16: distance of a distribution to the uniform one, and the earth mover's to another."""
    mag = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    e = t("embeddings").select("vec_id", mag.alias("m")).select("vec_id", F.transform(F.array(A.total(F.col("m"))), lambda s: F.transform("m", lambda x: x / s))[0].alias("p"))
    return e.select("vec_id", F.round(A.distance_to_uniform(F.col("p")), 6).alias("to_uniform"), F.round(A.earth_mover(F.col("p"), F.reverse("p")), 6).alias("mover"))


CELLS = "(select vec_id, k // 8 as i, k % 8 as j, v from (select vec_id, unnest(list_transform(embedding, lambda x: abs(x::double) / 2)) as v, unnest(range(0, 64)) as k from embeddings))"
METRICS = "avg_sc min_sc top_sc_mean top_sc_min sc_above_50 sc_above_40 sc_above_30 sc_above_20 sc_above_10 sc_share_wo_eos avg_sc_wo_eos avg_sc_wo_lang sc_entropy src_max_contr_below_001 src_max_contr_min src_sum_contr_below_01 src_sum_contr_mean src_sum_contr_min".split()


def matrices(t):
    """8 x 8 matrices from vectors."""
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, F.lit(8)), lambda x: F.abs(x.cast("double")) / 2))
    return t("embeddings").select("vec_id", m.alias("m"))


@query(
    f"""with s as (select * from {CELLS} where j < 5), r as (select vec_id, i, sum(v) as t, max(v) as top, sum(v) filter (j < 4) as wo from s group by vec_id, i), c as (select vec_id, j, sum(v) as t, max(v) as top from s group by vec_id, j),
e as (select vec_id, sum(v) filter (j = 4) as e, sum(v) as a from s group by vec_id),
x as (select vec_id, avg(t) as avg_sc, min(t) as min_sc, avg(top) as top_sc_mean, min(top) as top_sc_min, {", ".join(f"avg(case when t >= {c / 100} then 1.0 else 0.0 end) as sc_above_{c}" for c in (50, 40, 30, 20, 10))}, avg(wo) as avg_sc_wo_eos, avg(t) filter (i > 0) as avg_sc_wo_lang, sum(-(t / a) * ln(t / a)) as sc_entropy from r join e using (vec_id) group by vec_id),
y as (select vec_id, avg(case when top < 0.01 then 1.0 else 0.0 end) as src_max_contr_below_001, min(top) as src_max_contr_min, avg(case when t < 0.1 then 1.0 else 0.0 end) as src_sum_contr_below_01, avg(t) as src_sum_contr_mean, min(t) as src_sum_contr_min from c group by vec_id)
select vec_id, {", ".join(f"round({m}, 6) as {m}" for m in METRICS)} from (select *, 1 - e / a as sc_share_wo_eos from x join y using (vec_id) join e using (vec_id))"""
)
def cnt_contributions(t):
    """CNT-13: statistics of contribution matrices with five source tokens."""
    m = A.contribution_metrics(F.col("m"), F.lit(5))
    return matrices(t).select("vec_id", *(F.round(m[k], 6).alias(k) for k in METRICS))


@query(f"with c as {CELLS} select x.vec_id, cast(x.i as int) as i, cast(y.j as int) as j, round(sum(x.v * y.v), 6) as v from c x join c y on x.vec_id = y.vec_id and x.j = y.i group by all")
def vec_rollout(t):
    """VEC-20: products of a sentence's matrices."""
    r = matrices(t).select("vec_id", F.posexplode(A.product(F.col("m"), F.col("m"))).alias("i", "row")).select("vec_id", "i", F.posexplode("row").alias("j", "v"))
    return r.withColumn("v", F.round("v", 6))


@query(
    f"""with w as (select conv_id, turn, {scoring.TOKENS_SQL.format('src')} as h, {scoring.TOKENS_SQL.format('tgt')} as r, conv_id % 7 as g from {PAIRS}),
n as (select unnest(range(1, 5)) as n), hg as (select g, conv_id, turn, n, array_to_string(h[i:i + n - 1], ' ') as gram, count(*) as c from (select *, unnest(range(1, len(h) - n + 2)) as i from w, n) group by all),
rg as (select g, conv_id, turn, n, array_to_string(r[i:i + n - 1], ' ') as gram, count(*) as c from (select *, unnest(range(1, len(r) - n + 2)) as i from w, n) group by all),
m as (select hg.g, hg.n, sum(hg.c) as total, sum(coalesce(least(hg.c, rg.c), 0)) as hit from hg left join rg using (conv_id, turn, n, gram) group by hg.g, hg.n),
l as (select g, sum(len(h)) as lh, sum(len(r)) as lr from w group by g),
s as (select g, n, case when hit > 0 then hit / total else 1 / (pow(2, sum(case when hit = 0 then 1 else 0 end) over (partition by g order by n)) * total) end as p from m)
select g, round(100 * exp(avg(ln(p))) * exp(least(0, 1 - any_value(lr) / any_value(lh))), 4) as bleu from s join l using (g) group by g"""
)
def cnt_bleu(t):
    """CNT-24: corpus BLEU of groups of pairs, clipped counts of n-grams up to four, smoothed where none match."""
    p = pairs(t).withColumn("g", F.col("conv_id") % 7)
    return scoring.corpus_bleu(p, ["g"], ["conv_id", "turn"], "src", "tgt").withColumn("bleu", F.round("bleu", 4))


@query(f"select conv_id, turn, len({W.format('text')}) as n_words, cast(length(regexp_replace(text, '\\s', '', 'g')) as bigint) as n_chars, len(regexp_extract_all(lower(text), '[aeiouyàâäéèêëïîöôùûüáíóú]+')) as n_vowel_groups, 1 as n_sentences from conversations")
def cnt_speech_units(t):
    """CNT-25: words, characters, groups of vowels and sentences of an utterance."""
    groups = F.regexp_count(F.lower("text"), F.lit("[aeiouyàâäéèêëïîöôùûüáíóú]+"))
    return t("conversations").select("conv_id", "turn", F.size(words("text")).cast("long").alias("n_words"), F.length(F.regexp_replace("text", "\\s", "")).cast("long").alias("n_chars"), groups.cast("long").alias("n_vowel_groups"), F.lit(1).alias("n_sentences"))


@query(
    """with c as (select quality as x, toxic as y, count(*) as n from labels group by all), p as (select a.n * b.n as w, sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from c a, c b)
select round((select corr(quality, toxic) from labels), 6) as pearson, round(sum(w * sx * sy) / sqrt(sum(w * abs(sx)) * sum(w * abs(sy))), 6) as kendall from p"""
)
def cnt_correlations(t):
    """CNT-33: Pearson and Kendall's tau-b, by counts and not by pairs of rows or values."""
    p = ranks.pair_counts(ranks.counted(t("labels"), "quality", "toxic"))
    return t("labels").agg(F.round(F.corr("quality", "toxic"), 6).alias("pearson"), F.round(F.max(F.lit(p.tau_b()).cast("double")), 6).alias("kendall"))
