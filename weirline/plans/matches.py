"""Queries of exclusive matching and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.operators import family, intervals, matching, ranks
from weirline.plans.registry import query

#: Segments last a minute for each unit of value; pairs start in the same two hours.
SEGMENTS = "(select user_id, event_id, epoch(ts)::double as s, epoch(ts)::double + value * 60 as e from events where value > 0)"


@query(
    f"""with recursive p as (select a.user_id as key, a.event_id as i, b.event_id as j, a.s as a_s, a.e as a_e, b.s as b_s, b.e as b_e, round(1 - abs(a.s - b.s) / 7200, 6) as score
  from {SEGMENTS} a join {SEGMENTS} b on a.user_id = b.user_id and floor(a.s / 7200) = floor(b.s / 7200) and a.event_id % 2 = 0 and b.event_id % 2 = 1),
k as (select *, false as won from p where score > 0 union all
  select key, i, j, a_s, a_e, b_s, b_e, score, i = first.i and j = first.j from (
    select *, first_value({{'i': i, 'j': j, 'a_s': a_s, 'a_e': a_e, 'b_s': b_s, 'b_e': b_e}}) over (partition by key order by score desc, i, j) as first from k where not won)
  where (i = first.i and j = first.j) or not (i = first.i or j = first.j or (a_s < first.a_e and first.a_s < a_e) or (b_s < first.b_e and first.b_s < b_e)))
select key, i, j, round(score, 6) as score from k where won"""
)
def jn_exclusive(t):
    """JN-15: segments of a user's even and odd events matched best first; a match rules out all that overlap either side."""
    e = t("events").where("value > 0").selectExpr("user_id as key", "event_id", "unix_micros(cast(ts as timestamp)) / 1000000.0D as s0", "value").selectExpr("key", "event_id", "cast(s0 as double) as s", "cast(s0 as double) + value * 60 as e")
    near = [matching.symmetric(intervals.overlaps(e.where(F.col("event_id") % 2 == k), "key", "event_id", "s", "e", 7200.0)) for k in (0, 1)]
    side = lambda k, name, start: e.where(F.col("event_id") % 2 == k).select("key", F.col("event_id").alias(name), F.col("s").alias(start), F.floor(F.col("s") / 7200).alias("cell"))
    pairs = side(0, "i", "a_s").join(side(1, "j", "b_s"), ["key", "cell"])
    pairs = pairs.select("key", "i", "j", F.round(1 - F.abs(F.col("a_s") - F.col("b_s")) / 7200, 6).alias("score"))
    return matching.exclusive_matches(pairs, *near)


@query(
    """with c as (select c_acctbal as x, c_nationkey as y from customer), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2 as rx, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2 as ry from c),
p as (select sign(a.x - b.x) as sx, sign(a.y - b.y) as sy from c a, c b)
select round(sum(sx * sy) / sqrt(sum(abs(sx)) * sum(abs(sy))), 6) as kendall, (select round(corr(rx, ry), 6) from r) as spearman, round(avg(case when sx > 0 then 1.0 when sx < 0 then 0.0 else 0.5 end) filter (sy > 0), 6) as share from p"""
)
def cnt_rank_statistics(t):
    """CNT-33, CNT-16: tau-b, Spearman with average ranks and the share of ordered pairs of a column of many values against one of few."""
    counts = ranks.counted(t("customer"), "c_acctbal", "c_nationkey")
    p = ranks.pair_counts(counts)
    return ranks.spearman(counts).select(F.lit(p.tau_b()).cast("double").alias("kendall"), F.round("spearman", 6).alias("spearman"), F.lit(p.ordered_share()).cast("double").alias("share")).select(F.round("kendall", 6).alias("kendall"), "spearman", F.round("share", 6).alias("share"))


@query(
    """with recursive nodes as (select 's' || s_suppkey as id, 'n' || s_nationkey as parent from supplier union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'r' || r_regionkey, null from region),
line as (select id, id as ancestor, 0 as up from nodes union all select line.id, nodes.parent, up + 1 from line join nodes on nodes.id = line.ancestor where nodes.parent is not null),
below as (select ancestor, 's' || s_suppkey as relative, s_acctbal as w from line join supplier on line.id = 's' || s_suppkey where s_acctbal > 9000),
r as (select line.id, relative, up, row_number() over (partition by line.id order by up, w desc, relative) as k from line join below using (ancestor))
select id, relative, up from r where k = 1"""
)
def jn_nearest_relative(t):
    """JN-19: for every node of a tree (suppliers below nations below regions) the nearest of some leaves, the heaviest of equally near ones."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t("supplier").select(name("s", "s_suppkey").alias("id"), name("n", "s_nationkey").alias("parent"))
    nodes = nodes.unionByName(t("nation").select(name("n", "n_nationkey").alias("id"), name("r", "n_regionkey").alias("parent")))
    nodes = nodes.unionByName(t("region").select(name("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent")))
    return family.nearest_relatives(nodes, t("supplier").where("s_acctbal > 9000").select(name("s", "s_suppkey").alias("id"), F.col("s_acctbal").alias("weight")))


PLACE = "(select c_custkey as id, c_acctbal / 120 as latitude, (c_custkey * 37 % 360) - 180 as longitude from customer)"


@query(
    f"""with p as (select id, radians(latitude) as a, radians(longitude) as b from {PLACE}), d as (select x.id, y.id as relative, cos(x.a) * cos(x.b) * cos(y.a) * cos(y.b) + cos(x.a) * sin(x.b) * cos(y.a) * sin(y.b) + sin(x.a) * sin(y.a) as sim from p x, p y where y.id % 50 = 0)
select id, relative from (select *, row_number() over (partition by id order by round(sim, 9) desc, relative) as r from d) where r = 1"""
)
def jn_nearest_place(t):
    """JN-19: the fallback by great-circle distance: of every fiftieth customer's place the one nearest to each customer's."""
    p = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 120).alias("latitude"), (F.col("c_custkey") * 37 % 360 - 180).alias("longitude"))
    return family.nearest_places(p, p.where("id % 50 = 0"))
