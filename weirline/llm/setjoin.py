"""Similar sets: pairs inside buckets, and exact Jaccard search where buckets are large; native.

Buckets come as met (id, band, n): members and size of each bucket of two and more. All
members meet the least one first, then one that was linked with it (head_pairs). Where a
bucket is then in more than one component, up to SMALL members give all pairs between components; a larger bucket is dealt
into chunks whose members meet (bucket_pairs), and what that leaves out between different
components is searched exactly by prefixes in order of rarity (close_pairs).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import Scratch, connected_components

#: Members up to which a bucket gives all its pairs, and about how many a chunk of a larger one has.
SMALL, CHUNK = 256, 32
#: Bits of the map that keeps out of an exchange what has no partner: BITS_A_KEY or more a key, at least and at most these.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 25
#: Slots of the table of element counts; it only sets the order of elements, and any one order gives the same pairs.
SLOTS = 1 << 16
#: Longs of a set's parity sketch.
WORDS = 4
#: Rows of an element on the smaller components' side that a task compares at a time.
BLOCK = 1024
SLACK = 1e-9


def map_bits(n: int) -> int:
    """Bits of a bitmap() of n keys, a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_KEY * n - 1).bit_length())) if n else LEAST_BITS


def within(rows: DataFrame, used: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key has its bit set in a map of the keys of used, n or so; that is all rows with a used key and some more.

    It only spares the exchange of rows that have no partner. Bits grow with n, so that
    the share of other rows that pass does not, up to MOST_BITS (MOST_BITS / 64 rows are
    broadcast at most); beyond that more pass, never more than there are. What follows
    must be an inner join: Spark pushes a semi-join below this one, which then spares nothing.
    """
    size = F.lit(map_bits(n))
    bit = F.expr(f"shiftleft(1L, cast(pmod(`{key}`, 64) as int))")
    bits = used.select(F.floor(F.pmod(key, size) / 64).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    placed = rows.withColumn("word", F.floor(F.pmod(key, size) / 64)).join(F.broadcast(bits), "word")
    return placed.where(F.getbit("bits", F.pmod(key, F.lit(64)).cast("int")) == 1).drop("word", "bits")


def named(rows: DataFrame, used: DataFrame, key: str, n: int) -> DataFrame:
    """The rows whose key is in used (key), n different ones; of rows, only what within() lets pass is exchanged."""
    return within(rows, used, key, n).join(used, key)


def shared(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, band, n): the rows of keyed (id, band) whose band another row has; counts are pre-aggregated, and the join by band may be split."""
    counts = scratch.table(keyed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    return named(keyed, counts, "band", counts.count()).select("id", "band", "n")


def head_pairs(met: DataFrame, heads: DataFrame, brief: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """(a, b), a < b: each member of a bucket with the bucket's head of heads (band, head), where possible("l", "r") holds over columns of brief (id, ...)."""
    pairs = met.join(heads, "band").where("id <> head").select(F.least("id", "head").alias("head"), F.greatest("id", "head").alias("id")).distinct()
    l, r = brief.alias("l"), brief.alias("r")
    both = pairs.join(r, "id").select("head", F.struct(*(F.col(f"r.{x}") for x in brief.columns)).alias("r"))
    return both.join(l, F.col("head") == F.col("l.id")).where(possible("l", "r")).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))


def first_heads(met: DataFrame) -> DataFrame:
    """(band, head): the least member of each bucket."""
    return met.groupBy("band").agg(F.min("id").alias("head"))


def next_heads(members: DataFrame, tried: DataFrame) -> DataFrame:
    """(band, head) of open_members(): the least member, not tried (id) as a head yet, of each bucket's largest component.

    Where variants of one line fill a bucket, the first head is a variant and finds the
    line; the line, tried next, finds the others.
    """
    size = members.groupBy("band", "comp").agg(F.count("*").alias("c")).groupBy("band").agg(F.max(F.struct("c", "comp")).alias("m")).where("m.c > 1")
    own = members.join(size.select("band", F.col("m.comp").alias("comp")), ["band", "comp"])
    return first_heads(own.join(tried, "id", "left_anti"))


def open_members(met: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, band, n, comp) of the buckets that more than one component of parts (node, component) has."""
    named = met.join(parts, met.id == parts.node, "left").select("id", "band", "n", F.coalesce("component", "id").alias("comp"))
    of = named.groupBy("band").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("band")
    return named.join(of, "band", "left_semi")


def bucket_pairs(members: DataFrame, brief: DataFrame, possible: Callable[[str, str], Column]) -> DataFrame:
    """(a, b), a < b: pairs of different components inside buckets of open_members() for which possible("l", "r") holds.

    Pairs grow with the members, not with the square of a bucket: at most SMALL a member
    of a small bucket, CHUNK or so of a large one.
    """
    chunk = F.when(F.col("n") > SMALL, F.pmod(F.xxhash64("id", "band"), F.ceil(F.col("n") / CHUNK))).otherwise(0)
    own = members.withColumn("chunk", chunk.cast("int")).drop("n").join(brief, "id")
    l, r, c = own.alias("l"), own.alias("r"), F.col
    same = (c("l.band") == c("r.band")) & (c("l.chunk") == c("r.chunk")) & (c("l.id") < c("r.id")) & (c("l.comp") != c("r.comp"))
    return l.join(r, same & possible("l", "r")).select(c("l.id").alias("a"), c("r.id").alias("b")).distinct()


def joined(parts: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """parts (node, component) after further links (u, v)."""
    old = scratch.table(parts)
    u, v = old.toDF("u", "cu"), old.toDF("v", "cv")
    more = links.join(u, "u", "left").join(v, "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).distinct()
    far = scratch.table(connected_components(more, scratch)).toDF("component", "far")
    moved = old.join(far, "component", "left").select("node", F.coalesce("far", "component").alias("component"))
    new = far.join(old, far.component == old.node, "left_anti").select(F.col("component").alias("node"), F.col("far").alias("component"))
    return moved.unionByName(new)


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """(id, n, x, pre): size, parity sketch and the first elements of each set (id, h of different longs), rarest first.

    Sets that reach the similarity share one of their first n - similarity * n + 1 elements
    in any common order. Counts by slot are broadcast, so no element is exchanged.
    """
    slot = F.pmod("h", F.lit(SLOTS)).alias("slot")
    rows = sets.repartition("id").select("id", F.explode("h").alias("h"))
    counts = sets.select(F.explode("h").alias("h")).groupBy(slot).agg(F.count("*").alias("f"))
    ranked = rows.withColumn("slot", slot).join(F.broadcast(counts), "slot")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(h, 32), 64) as int))")
    word = F.pmod(F.shiftright("h", 40), F.lit(WORDS))
    sketch = (F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0).cast("long")) for k in range(WORDS))
    one = ranked.groupBy("id").agg(F.count("*").alias("n"), F.array(*sketch).alias("x"), F.sort_array(F.collect_list(F.struct("f", "h"))).alias("all"))
    first = F.floor((1 - similarity) * F.col("n") + SLACK).cast("int") + 1
    return one.select("id", "n", "x", F.slice("all", F.lit(1), first)["h"].alias("pre"))


def possible(n, m, sketches, similarity: float):
    """Whether sets of n and m elements can reach the similarity: by their sizes, and by bits in which parity sketches differ."""
    bits = [F.bit_count(x.bitwiseXOR(y)) for x, y in sketches]
    return reachable(n, m, sum(bits[1:], bits[0]), similarity)


def reachable(n, m, differing, similarity: float):
    """Whether sets of n and m elements, of which at least `differing` are not common, can reach the similarity."""
    common = F.least(n, m, (n + m - differing) / 2)
    return common * (1 + similarity) + SLACK >= similarity * (n + m)


def close_pairs(pre: DataFrame, similarity: float, words: int = WORDS) -> DataFrame:
    """(a, b), a < b, of prefixes() with a column comp: all pairs of different comp that can reach the similarity, and some that do not.

    Members of an element's largest component meet its other members only, so a group of
    copies that is one component costs nothing where it is alone and is linear beside few
    others. The shorter set of a pair is found by fewer elements still. A pair meets at a
    common element, which leaves each side at least the overlap it needs; parity sketches
    differ in at most as many bits as the sets in elements. Elements with many sets are
    dealt over blocks; every pair of them still meets.
    """
    rows = pre.select("id", "n", "comp", *(F.col("x")[k].alias(f"x{k}") for k in range(words)), F.posexplode("pre").alias("at", "h"))
    held = rows.groupBy("h", "comp").agg(F.count("*").alias("c"))
    held = held.groupBy("h").agg(F.max(F.struct("c", "comp"))["comp"].alias("major"), F.count("*").alias("comps"), (F.sum("c") - F.max("c")).alias("others"))
    held = held.where("comps > 1").select("h", "major", F.ceil(F.col("others") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(held, "h")
    c = F.col
    left = rows.where(c("comp") != c("major")).withColumn("block", F.pmod(F.xxhash64("id"), c("blocks")).cast("int")).drop("blocks", "major").alias("l")
    right = rows.withColumn("block", F.explode(F.sequence(F.lit(0), c("blocks") - 1))).drop("blocks").alias("r")
    once = (c("r.comp") == c("r.major")) | (c("l.id") < c("r.id"))
    met = (c("l.h") == c("r.h")) & (c("l.block") == c("r.block")) & (c("l.comp") != c("r.comp")) & once
    brief = lambda s: c(f"{s}.at") <= F.floor((1 - similarity) / (1 + similarity) * c(f"{s}.n") + SLACK)
    met = met & F.when(c("l.n") < c("r.n"), brief("l")).when(c("l.n") > c("r.n"), brief("r")).otherwise(brief("l") | brief("r"))
    left_over = F.least(c("l.n") - c("l.at"), c("r.n") - c("r.at"))
    met = met & (left_over * (1 + similarity) + SLACK >= similarity * (c("l.n") + c("r.n")))
    met = met & possible(c("l.n"), c("r.n"), [(c(f"l.x{k}"), c(f"r.x{k}")) for k in range(words)], similarity)
    both = left.join(right, met)
    return both.select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
