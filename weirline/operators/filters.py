"""Ordered filter chains with exact reject counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chain(df: DataFrame, rules: list[tuple[str, Column]], reason: str = "reject_reason") -> DataFrame:
    """Adds the first rule that rejects a row; a later rule counts only rows that reached it. Null condition: passes."""
    out = F.lit(None).cast("string")
    for name, rejects in reversed(rules):
        out = F.when(rejects, F.lit(name)).otherwise(out)
    return df.withColumn(reason, out)


def counters(df: DataFrame, group: str, reasons: list[str], reason: str = "reject_reason") -> DataFrame:
    """total_before, total_after and a count per reason, per group: one partial aggregate."""
    return df.groupBy(group).agg(
        F.count("*").alias("total_before"),
        F.count_if(F.col(reason).isNull()).alias("total_after"),
        *(F.count_if(F.col(reason) == r).alias(f"n_{r}") for r in reasons),
    )


def score_at_least(score: Column, threshold: float) -> Column:
    """Passes null and zero scores too."""
    return score.isNull() | (score == 0) | (score >= threshold)


def length_reason(src: Column, tgt: Column, min_len=5, max_len=500, max_ratio=2.0, factor: float = 1.0) -> Column:
    a, b = F.greatest(F.lit(1.0), F.length(src) * F.lit(float(factor))), F.greatest(F.lit(1.0), F.length(tgt) * F.lit(1.0))
    return (
        F.when((F.length(src) == 0) | (F.length(tgt) == 0), "empty")
        .when((a < min_len) | (b < min_len), "min_len")
        .when((a > max_len) | (b > max_len), "max_len")
        .when(F.greatest(a / b, b / a) > max_ratio, "max_len_ratio")
    )


def language_accepts(src_prob: Column, tgt_prob: Column, src_least: float | None, tgt_least: float | None, excluded: Column | None = None) -> Column:
    """Whether both sides reach their thresholds; no threshold, and excluded rows, pass."""
    ok = F.lit(True)
    for prob, least in ((src_prob, src_least), (tgt_prob, tgt_least)):
        ok = ok & (prob >= least) if least else ok
    return ok if excluded is None else excluded | ok


def reject_repeats(df: DataFrame, key: list[str], order: list[str], name: str, reason: str = "reject_reason") -> DataFrame:
    """Rejects passed rows whose key an earlier passed row has: minima a key, pre-aggregated and joined back."""
    at = F.struct(*order)
    first = df.where(F.col(reason).isNull()).groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.min(at).alias("_first"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    met = df.join(first, same, "left")
    return met.withColumn(reason, F.when(F.col(reason).isNull() & (at != F.col("_first")), name).otherwise(F.col(reason))).drop("_first", *(f"_{k}" for k in key))
