"""Queries of aggregations and counters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weirline.operators import ranks
from weirline.plans.registry import query


@query("select lang, source, count(*) as n, sum(n_chars) as chars, grouping_id(lang, source) as g from documents group by grouping sets ((lang, source), (lang), (source), ())")
def cnt_grouping_sets(t):
    """CNT-04, CNT-09: counts over several key lists in one pass."""
    g = t("documents").cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id("lang", "source").alias("g"))
    return g


@query("select lang, count(*) filter (quality = 0) as q0, count(*) filter (quality = 1) as q1, count(*) as total from documents join labels using (doc_id) group by lang")
def cnt_pivot(t):
    """CNT-10, CNT-30, CNT-32, JN-10: pivoted counts."""
    p = t("documents").join(t("labels"), "doc_id").groupBy("lang").pivot("quality", [0, 1]).agg(F.count("doc_id"))
    return p.select("lang", F.coalesce("0", F.lit(0)).alias("q0"), F.coalesce("1", F.lit(0)).alias("q1"), (F.coalesce("0", F.lit(0)) + F.coalesce("1", F.lit(0))).alias("total"))


@query("with c as (select event_type, user_id % 50 as u, count(*) as n from events group by all), s as (select u, sum(n) as t from c group by u) select u, round(1 - sum((n / t) * (n / t)), 6) as gini, round(-sum((n / t) * ln(n / t)), 6) as entropy from c join s using (u) group by u")
def cnt_impurity_entropy(t):
    """CNT-14, CNT-15: two-level aggregates."""
    c = t("events").groupBy((F.col("user_id") % 50).alias("u"), "event_type").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("u"))
    return c.withColumn("p", p).groupBy("u").agg(F.round(1 - F.sum(F.col("p") * F.col("p")), 6).alias("gini"), F.round(-F.sum(F.col("p") * F.log("p")), 6).alias("entropy"))


@query("with x as (select toxic as y, quality as x from labels) select round(avg(case when a.x < b.x then 1.0 when a.x > b.x then 0.0 else 0.5 end), 6) as share from x a join x b on a.y < b.y")
def cnt_correct_pairs(t):
    """CNT-16, CNT-34: share of correctly ordered pairs, by counts and not by pairs of rows or values."""
    p = ranks.pair_counts(ranks.counted(t("labels"), "quality", "toxic"))
    return t("labels").agg(F.round(F.max(F.lit(p.ordered_share()).cast("double")), 6).alias("share"))


@query("select round(corr(c_acctbal, c_nationkey), 6) as pearson from customer")
def cnt_pearson(t):
    """CNT-18."""
    return t("customer").agg(F.round(F.corr("c_acctbal", "c_nationkey"), 6).alias("pearson"))


@query("with r as (select dense_rank() over (order by quality) as a, dense_rank() over (order by toxic) as b from labels) select round(corr(a, b), 6) as spearman from r")
def cnt_dense_rank_spearman(t):
    """CNT-17: ranks come from the different values, not from an order of all rows."""
    lab = t("labels")
    rank = lambda c: lab.select(c).distinct().withColumn(f"r_{c}", F.dense_rank().over(Window.orderBy(c)))
    j = lab.join(rank("quality"), "quality").join(rank("toxic"), "toxic")
    return j.agg(F.round(F.corr("r_quality", "r_toxic"), 6).alias("spearman"))


@query("select lang, round(sum(n_chars) / (select sum(n_chars) from documents where lang = 'en'), 6) as factor from documents group by lang")
def cnt_length_factor(t):
    """CNT-22: length of each language against English."""
    s = t("documents").groupBy("lang").agg(F.sum("n_chars").alias("n"))
    en = s.where("lang = 'en'").select(F.col("n").alias("en"))
    return s.crossJoin(F.broadcast(en)).select("lang", F.round(F.col("n") / F.col("en"), 6).alias("factor"))


@query("with k as (select source, avg(case when n_chars > 1000 then 1.0 else 0.0 end) as share from documents group by source), m as (select avg(share) as m, stddev_pop(share) as s from k) select source, round(share, 6) as share, abs(share - m) > 1.5 * s as outlier from k, m")
def cnt_outlier_files(t):
    """CNT-21: files whose kept share is far from the mean."""
    k = t("documents").groupBy("source").agg(F.avg((F.col("n_chars") > 1000).cast("double")).alias("share"))
    m = k.agg(F.avg("share").alias("m"), F.stddev_pop("share").alias("s"))
    return k.crossJoin(F.broadcast(m)).select("source", F.round("share", 6).alias("share"), (F.abs(F.col("share") - F.col("m")) > 1.5 * F.col("s")).alias("outlier"))


@query("select o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) as best from orders group by o_custkey")
def cnt_best_of(t):
    """CNT-23: the row with the best score."""
    return t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("best"))


@query("select event_type, count(value) as n, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as sd, min(value) as lo, round(quantile_cont(value, 0.5), 6) as med, max(value) as hi from events group by event_type")
def cnt_describe(t):
    """CNT-26: description of a score."""
    v = F.col("value")
    return t("events").groupBy("event_type").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("sd"), F.min(v).alias("lo"), F.round(F.percentile(v, 0.5), 6).alias("med"), F.max(v).alias("hi"))


@query("select round(floor(value / 0.5) * 0.5 + 0.25, 3) as bin, count(*) as n from events where value is not null group by 1")
def cnt_bins(t):
    """CNT-35: counts in equal bins."""
    return t("events").where("value is not null").groupBy(F.round(F.floor(F.col("value") / 0.5) * 0.5 + 0.25, 3).alias("bin")).agg(F.count("*").alias("n"))


@query("with w as (select event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) select a, b, count(*) as n from w where b is not null group by a, b having count(*) >= 5")
def cnt_pair_frequency(t):
    """CNT-07: frequent pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    p = t("events").select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b")).where("b is not null")
    return p.groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 5")


@query("select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n from lineitem group by l_returnflag, l_linestatus")
def cnt_lineitem_summary(t):
    """CNT-02: field-wise sums."""
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


EDGES = "(select user_id, list_distinct(list(event_type)) filter (event_id % 2 = 0) as h, list(distinct event_type) filter (event_id % 3 = 0) as s from events group by user_id)"


@query("with e as (select distinct user_id, event_type from events where event_id % 2 = 0), s as (select distinct user_id, event_type from events where event_id % 3 = 0), m as (select user_id, count(*) as n from e join s using (user_id, event_type) group by user_id), a as (select user_id, count(*) as ne from e group by user_id), b as (select user_id, count(*) as ns from s group by user_id) select user_id, round(coalesce(n, 0) / ne, 6) as precision, round(coalesce(n, 0) / ns, 6) as recall from a join b using (user_id) left join m using (user_id)")
def set_edge_metrics(t):
    """SET-09: precision and recall of edge sets."""
    e = t("events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("h"), F.collect_set(F.when(F.col("event_id") % 3 == 0, F.col("event_type"))).alias("s"))
    n = F.size(F.array_intersect("h", "s"))
    return e.where("size(h) > 0 and size(s) > 0").select("user_id", F.round(n / F.size("h"), 6).alias("precision"), F.round(n / F.size("s"), 6).alias("recall"))
