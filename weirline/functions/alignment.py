"""Columns over words, tokens, edges and contribution matrices of one sentence pair: higher-order functions, no exchange."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.nullif(F.size(a), F.lit(0))


def share(a: Column, test) -> Column:
    """Share of the elements for which test holds."""
    return F.size(F.filter(a, test)) / F.nullif(F.size(a), F.lit(0))


def f1(x: Column, y: Column, eps: float = 1e-10) -> Column:
    return x * y * 2 / F.greatest(x + y, F.lit(eps))


def short_long_ratio(x: Column, y: Column) -> Column:
    """Shorter over longer of two non-negative numbers; 1 if both are zero."""
    return F.when((x == 0) & (y == 0), 1.0).otherwise(F.least(x, y) / F.greatest(x, y))


def edges(text: Column, one_based: bool = False, reverse: bool = False) -> Column:
    """Edges i-j (sure) and ipj (possible) of a text as structs (i, j, sure)."""
    shift = int(one_based)

    def one(x: Column) -> Column:
        a, b = (F.regexp_extract(x, "^(\\d+)[-p](\\d+)$", k).cast("int") - shift for k in (1, 2))
        return F.struct((b if reverse else a).alias("i"), (a if reverse else b).alias("j"), (~F.contains(x, F.lit("p"))).alias("sure"))

    return F.transform(F.filter(F.split(text, " "), lambda x: x.rlike("^\\d+[-p]\\d+$")), one)


def edge_scores(found: Column, sure: Column, possible: Column) -> Column:
    """Struct (precision, recall, aer) of found edges (i, j) against sure ones and possible ones, which include the sure."""
    n, both, all_ = F.size(found), F.size(F.array_intersect(found, sure)), F.size(F.array_intersect(found, possible))
    none = lambda x: F.nullif(x, F.lit(0))
    return F.struct((all_ / none(n)).alias("precision"), (both / none(F.size(sure))).alias("recall"), (1 - (both + all_) / none(n + F.size(sure))).alias("aer"))


def noncross_ratio(i: Column, j: Column, strong: Column, weak: Column, weight: float = 0.1) -> Column:
    """Weighted share of the word edges (i, j) that don't cross an edge between the pauses after words i and j; 1 without edges."""
    keeps = lambda p: ((p["i"] - (i + 0.5)) * (p["j"] - (j + 0.5)) > 0)
    num = F.size(F.filter(strong, keeps)) + weight * F.size(F.filter(weak, keeps))
    den = F.size(strong) + weight * F.size(weak)
    return F.when(den == 0, 1.0).otherwise(num / den)


def flagged_on_other_side(flags: Column, alignment: Column) -> Column:
    """Places j of the other side that an edge (i, j) joins to a flagged place i, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(alignment, lambda e: F.array_contains(flags, e["i"])), lambda e: e["j"])))


def word_starts(text: Column) -> Column:
    """Structs (word, s, e) of the words of a text, code point offsets [s, e)."""
    words = F.regexp_extract_all(text, F.lit("\\S+"), F.lit(0))
    gaps = F.split(text, "\\S+", -1)
    step = lambda a, x: F.struct((a["at"] + x["g"] + F.length(x["w"])).alias("at"), F.concat(a["out"], F.array(F.struct(x["w"].alias("word"), (a["at"] + x["g"]).alias("s"), (a["at"] + x["g"] + F.length(x["w"])).alias("e")))).alias("out"))
    both = F.transform(words, lambda w, k: F.struct(w.alias("w"), F.length(F.get(gaps, k)).alias("g")))
    return F.aggregate(both, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<word:string,s:int,e:int>>)").alias("out")), step, lambda a: a["out"])


def merged_tokens(tokens: Column, mark: str = "▁") -> Column:
    """Words of sub-tokens: a token that starts with the mark begins one."""
    return F.filter(F.split(F.array_join(tokens, ""), mark), lambda w: w != "")


def marked_up(words: Column, pauses: Column, emphasis: Column, least_pause: float = 0.1, least_emphasis: float = 0.5) -> Column:
    """Text with pauses as [pause x 0.20] after words and emphasis as *word*; neighbours share their stars."""
    word = lambda w, k: F.when(F.get(emphasis, k) > least_emphasis, F.concat(F.lit("*"), w, F.lit("*"))).otherwise(w)
    pause = lambda k: F.when(F.get(pauses, k) > least_pause, F.concat(F.lit(" [pause x "), F.format_number(F.get(pauses, k), 2), F.lit("]"))).otherwise("")
    return F.replace(F.array_join(F.transform(words, lambda w, k: F.concat(word(w, k), pause(k))), " "), F.lit("* *"), F.lit(" "))


def distance_to_uniform(a: Column) -> Column:
    """Half the L1 distance of a distribution to the uniform one."""
    return 0.5 * total(F.transform(a, lambda x: F.abs(x - 1 / F.size(a))))


def earth_mover(a: Column, b: Column) -> Column:
    """Earth mover's distance of two distributions over places 0, 1, ...: the sum of differences of running sums."""
    step = lambda s, d: F.struct((s["run"] + d).alias("run"), (s["out"] + F.abs(s["run"] + d)).alias("out"))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x - y), F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("out")), step, lambda s: s["out"])


def column_sums(m: Column) -> Column:
    return F.aggregate(F.slice(m, 2, F.size(m)), F.get(m, 0), lambda s, r: F.zip_with(s, r, lambda x, y: x + y))


def column_max(m: Column) -> Column:
    return F.aggregate(F.slice(m, 2, F.size(m)), F.get(m, 0), lambda s, r: F.zip_with(s, r, lambda x, y: F.greatest(x, y)))


def product(a: Column, b: Column) -> Column:
    """Matrix product of nested arrays."""
    return F.transform(a, lambda r: F.aggregate(F.zip_with(r, b, lambda x, row: F.transform(row, lambda y: x * y)), F.transform(F.get(b, 0), lambda _: F.lit(0.0)), lambda s, row: F.zip_with(s, row, lambda x, y: x + y)))


def contribution_metrics(m: Column, n_source: Column) -> dict[str, Column]:
    """Statistics of a contribution matrix (rows: predicted tokens; the first n_source columns: source tokens, an end mark last)."""
    sc = F.transform(m, lambda r: F.slice(r, F.lit(1), n_source))
    by_tgt, top_tgt = F.transform(sc, total), F.transform(sc, F.array_max)
    by_src, top_src = column_sums(sc), column_max(sc)
    ends = total(F.transform(sc, lambda r: F.element_at(r, -1)))
    p = F.transform(by_tgt, lambda x: x / total(by_tgt))
    out = {"avg_sc": mean(by_tgt), "min_sc": F.array_min(by_tgt), "top_sc_mean": mean(top_tgt), "top_sc_min": F.array_min(top_tgt)}
    for cut in (50, 40, 30, 20, 10):
        out[f"sc_above_{cut}"] = share(by_tgt, _over(cut / 100))
    out["sc_share_wo_eos"] = 1 - ends / total(by_tgt)
    out["avg_sc_wo_eos"] = mean(F.transform(sc, lambda r: total(F.slice(r, F.lit(1), F.size(r) - 1))))
    out["avg_sc_wo_lang"] = mean(F.slice(by_tgt, F.lit(2), F.greatest(F.size(by_tgt) - 1, F.lit(0))))
    out["sc_entropy"] = total(F.transform(p, lambda x: -x * F.log(x)))
    out["src_max_contr_below_001"] = share(top_src, lambda x: x < 0.01)
    out["src_max_contr_min"] = F.array_min(top_src)
    out["src_sum_contr_below_01"] = share(by_src, lambda x: x < 0.10)
    out["src_sum_contr_mean"] = mean(by_src)
    out["src_sum_contr_min"] = F.array_min(by_src)
    return out


def _over(cut: float):
    return lambda x: x >= cut
