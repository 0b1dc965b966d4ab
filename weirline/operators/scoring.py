"""Corpus scores from partial aggregates: BLEU, rank correlation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The tokenizer's rules, punctuation apart from words, points and commas apart unless between digits.
RULES = ((r"([\x{7b}-\x{7e}\x{5b}-\x{60}\x{20}-\x{26}\x{28}-\x{2b}\x{3a}-\x{40}/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "))


def _sql(t: str) -> str:
    for pattern, by in RULES:
        t = f"regexp_replace({t}, '{pattern}', '{by.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')"


#: tokens() as SQL, with {} for the text.
TOKENS_SQL = "{}".join(_sql("\0").replace("{", "{{").replace("}", "}}").split("\0"))


def tokens(t: Column, how: str = "13a") -> Column:
    """Tokens of a text: words and punctuation, or single characters (char)."""
    if how == "char":
        return F.filter(F.split(F.regexp_replace(t, "\\s", ""), ""), lambda w: w != "")
    for pattern, by in RULES:
        t = F.regexp_replace(t, pattern, by)
    return F.filter(F.split(t, "\\s+"), lambda w: w != "")


def clipped_counts(order: int):
    """(hyps, refs) -> array of (total, hit) for n from 1: n-grams of a row's texts (lists of tokens), and those that its references have as often.

    As in the SQL of cnt_bleu (least() passes over a null), an n-gram that the references lack is not clipped: it counts as a hit.
    """
    from collections import Counter

    def grams(texts: list[list[str]], n: int) -> Counter:
        return Counter(tuple(t[i : i + n]) for t in texts for i in range(len(t) - n + 1))

    @F.arrow_udf("array<struct<total:bigint,hit:bigint>>")
    def run(hyps: pa.Array, refs: pa.Array) -> pa.Array:
        out = []
        for h, r in zip(hyps, refs):
            h, r, found = h.as_py(), r.as_py(), []
            for n in range(1, order + 1):
                a, b = grams(h, n), grams(r, n)
                found.append({"total": a.total(), "hit": sum(min(c, b.get(g, c)) for g, c in a.items())})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("total", pa.int64()), ("hit", pa.int64())])))

    return run


def corpus_bleu(df: DataFrame, groups: list[str], row: list[str], hyp: str, ref: str, how: str = "13a", order: int = 4) -> DataFrame:
    """(groups, bleu) of texts hyp against ref, row by row.

    Clipped counts are made where a row's texts are; what reaches a group is a sum for each n.
    An n without a match counts as half the one before it (exponential smoothing). Rows of
    one key count as one row of several texts.
    """
    keys = [*groups, *row]
    rows = df.select(*keys, tokens(F.col(hyp), how).alias("h"), tokens(F.col(ref), how).alias("r"))
    texts = rows.groupBy(*keys).agg(F.collect_list("h").alias("h"), F.collect_list("r").alias("r"))
    lengths = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    counts = texts.select(*groups, lengths("h").alias("lh"), lengths("r").alias("lr"), F.posexplode(clipped_counts(order)("h", "r")).alias("k", "c"))
    m = counts.groupBy(*groups, (F.col("k") + 1).alias("n")).agg(*(F.sum(c).alias(c) for c in ("lh", "lr")), F.sum("c.total").alias("total"), F.sum("c.hit").alias("hit")).where("total > 0")
    missed = F.sum((F.col("hit") == 0).cast("int")).over(Window.partitionBy(*groups).orderBy("n"))
    p = F.when(F.col("hit") > 0, F.col("hit") / F.col("total")).otherwise(1 / (F.pow(F.lit(2), missed) * F.col("total")))
    scores = m.withColumn("p", p).groupBy(*groups).agg(F.avg(F.log("p")).alias("mean"), F.max("lh").alias("lh"), F.max("lr").alias("lr"))
    return scores.select(*groups, (100 * F.exp("mean") * F.exp(F.least(F.lit(0.0), 1 - F.col("lr") / F.col("lh")))).alias("bleu"))
