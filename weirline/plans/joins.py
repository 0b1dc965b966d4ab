"""Queries of joins, vectors and intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import vectors as V
from weirline.operators import intervals, mining
from weirline.plans.registry import query

SIDES = "select vec_id as id, embedding::double[] as v from embeddings where vec_id % 2 = "


def side(t, k: int):
    return t("embeddings").where(f"vec_id % 2 = {k}").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(
    """with v as (select vec_id as id, embedding::double[] as v from embeddings), p as (select x.id as q_id, y.id as b_id, list_dot_product(x.v, y.v) as sim from v x, v y where x.id % 50 = 0), r as (select *, row_number() over (partition by q_id order by round(sim, 9) desc, b_id) as rank from p)
select q_id, b_id, rank, round(sim, 5) as sim from r where rank <= 4"""
)
def jn_knn(t):
    """JN-04, JN-05, VEC-03: k nearest by inner product for every fiftieth row against all rows, in tiles, partial and final ranking."""
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return mining.knn(rows.where("id % 50 = 0"), rows, 4).select("q_id", "b_id", "rank", F.round("sim", 5).alias("sim"))


@query(
    f"""with p as (select x.id as s, y.id as g, list_dot_product(x.v, y.v) as sim from ({SIDES}0) x, ({SIDES}1) y),
f as (select * from (select *, row_number() over (partition by s order by round(sim, 9) desc, g) as r from p) where r <= 4),
b as (select * from (select *, row_number() over (partition by g order by round(sim, 9) desc, s) as r from p) where r <= 4),
u as (select s, g, sim, 'f' as dir from f union all select s, g, sim, 'b' from b)
select s as src_id, g as tgt_id, dir, round(sim / ((ms.m + mg.m) / 2), 5) as score from u join (select s, avg(sim) as m from f group by s) ms using (s) join (select g, avg(sim) as m from b group by g) mg using (g)
where sim / ((ms.m + mg.m) / 2) >= 1.04"""
)
def vec_margin_mining(t):
    """VEC-05..08, VEC-10, VEC-11, SET-02, SRT-03, FLT-14: both directions over the margin."""
    return mining.mine(side(t, 0), side(t, 1), index="Flat").select("src_id", "tgt_id", "dir", F.round("score", 5).alias("score"))


@query("select vec_id, list_transform(embedding, lambda x: round(x::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) + 0.0) as v from embeddings")
def vec_l2_normalize(t):
    """VEC-01."""
    return t("embeddings").select("vec_id", F.transform(V.l2_normalize(F.col("embedding")), lambda x: F.round(x, 5)).alias("v"))


@query("select a.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 5) as cos from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def vec_rowwise_cosine(t):
    """VEC-02, VEC-04, UDF-15: cosine of paired rows."""
    e = t("embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 5).alias("cos"))


INTERVALS = "(select event_id as id, user_id, epoch(ts) as s, epoch(ts) + value as e from events where value > 0)"


@query(f"select a.user_id, a.id as a, b.id as b, round(least(a.e, b.e) - greatest(a.s, b.s), 3) as overlap from {INTERVALS} a join {INTERVALS} b on a.user_id = b.user_id and a.id < b.id and a.s < b.e and b.s < a.e")
def jn_interval_overlap(t):
    """JN-07: overlaps within a key by buckets."""
    ev = t("events").where("value > 0").selectExpr("user_id", "event_id as id", "unix_micros(cast(ts as timestamp)) / 1000000.0D as s", "value").selectExpr("user_id", "id", "cast(s as double) as s", "cast(s as double) + value as e")
    return intervals.overlaps(ev, "user_id", "id", "s", "e", 3600.0).select("user_id", "a", "b", F.round("overlap", 3).alias("overlap"))


@query("select d.doc_id, d.lang, l.quality from documents d left join labels l using (doc_id)")
def jn_left_labels(t):
    """JN-09, JN-20, JN-21: left join of scores."""
    return t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


@query("select o.o_orderkey, c.c_name, n.n_name from orders o join customer c on c.c_custkey = o.o_custkey join nation n on n.n_nationkey = c.c_nationkey")
def jn_lookup(t):
    """JN-02: row ids to their texts."""
    o = t("orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    return o.join(t("customer"), F.col("k") == F.col("c_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("select source, n, cast(sum(n) over (order by source rows between unbounded preceding and 1 preceding) as bigint) as first_row from (select source, count(*) as n from documents group by source)")
def jn_row_offsets(t):
    """JN-03: where each shard starts, by sums over shards."""
    from pyspark.sql import Window

    n = t("documents").groupBy("source").agg(F.count("*").alias("n"))  # a row a shard
    return n.withColumn("first_row", F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)))


@query("with s as (select conv_id, role, count(*) as n from conversations group by conv_id, role) select a.conv_id, a.role as role_a, b.role as role_b, a.n * b.n as n from s a join s b on a.conv_id = b.conv_id and a.role < b.role")
def jn_pairs_per_key(t):
    """JN-11, SRC-40: unordered pairs of a key's few kinds."""
    s = t("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"))
    a, b = s.toDF("conv_id", "role_a", "na"), s.toDF("conv_id", "role_b", "nb")
    return a.join(b, "conv_id").where("role_a < role_b").select("conv_id", "role_a", "role_b", (F.col("na") * F.col("nb")).alias("n"))
