"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8

# The stop words counted, by language.
STOP_WORDS = {
    "en": "the of and to in is that it for on with as was be by are this at from or",
    "fr": "de la le les et des en un du une est que qui dans par pour sur pas au aux",
    "de": "der die und in den von zu das mit sich auf für ist im dem nicht ein eine als auch",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}


@dataclass(frozen=True)
class Rule:
    """Reject where value < least or value > most; value is SQL over the measured columns. Null passes."""

    name: str
    value: str
    least: float | None = None
    most: float | None = None

    def fails(self) -> Column:
        tests = [f"{self.value} < {self.least}"] * (self.least is not None) + [f"{self.value} > {self.most}"] * (self.most is not None)
        return F.coalesce(F.expr(" or ".join(tests)), F.lit(False))


BASE = (
    Rule("few_words", "n_words", least=20),
    Rule("repeated_words", "100 * n_repeat_words - 30 * n_words", most=0),
)
#: The method's own thresholds.
RULES = (
    Rule("word_length", "word_chars / nullif(n_words, 0)", 2.0, 12.0),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", most=0.1),
    Rule("stop_words", "n_stop_words / nullif(n_words, 0)", least=0.03),
    Rule("repeated_lines", "n_dup_lines / nullif(n_lines, 0)", most=0.5),
)


def stop_words(words: Column, lang: Column | None, lists: dict[str, str]) -> Column:
    """Words of a text that are stop words of its language; null, which no rule rejects, where the language is none of the lists' or unknown."""
    out = F.lit(None).cast("long")
    for name, listed in lists.items() if lang is not None else ():
        out = F.when(lang == name, F.size(F.filter(words, lambda w: F.lower(w).isin(*listed.split()))).cast("long")).otherwise(out)  # noqa: B023
    return out


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, lang_col: str | None = "lang", lists: dict[str, str] = STOP_WORDS) -> DataFrame:
    """The kept columns with n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words.

    n_stop_words is by the language that lang_col names and null where lists have none for
    it, or where there is no such column: a text of another language is not held against them.

    Three projections in one map stage: Catalyst leaves them apart, since each uses the
    one before several times. A window is its eight words' XXH64; only a text with a
    window twice sorts its windows. Windows found twice start at sorted places p, and
    cover min(8, next p - p) words each: O(n log n) for texts of any length.
    """
    kept = [F.col(f"`{c}`") for c in keep or []]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    lang = F.col(f"`{lang_col}`") if lang_col in docs.columns else F.lit(None).cast("string")
    first = docs.select(*kept, lang.alias("_lang"), words.alias("_words"), lines.alias("_lines"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    n = F.size("_words")
    grams = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))))
    second = first.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        "n_symbols",
        stop_words(F.col("_words"), F.col("_lang"), lists).alias("n_stop_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        grams.alias("_grams"),
    )
    twice = F.size(F.array_distinct("_grams")) < F.size("_grams")
    placed = F.sort_array(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rest = [c for c in second.columns if c != "_grams"]
    rest = [F.col(f"`{c}`") for c in rest]
    third = second.select(*rest, F.when(twice, placed).alias("_placed"))
    h = lambda k: F.get("_placed", k)["h"]
    same = lambda k: F.coalesce(h(k - 1) == h(k), F.lit(False)) | F.coalesce(h(k + 1) == h(k), F.lit(False))
    at = F.filter(F.sequence(F.lit(0), F.size("_placed") - 1), same)
    fourth = third.select(*rest, F.sort_array(F.transform(F.when(F.col("_placed").isNotNull(), at), lambda k: F.get("_placed", k)["i"])).alias("_at"))
    cover = F.transform("_at", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - p, F.lit(WINDOW))))
    return fourth.select(*rest, F.coalesce(F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")).alias("n_repeat_words"))


def judged(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, lang_col: str | None = "lang") -> DataFrame:
    """measured() with base_failed, kept and reasons (names of the rules that reject, in table order).

    Null, empty or blank text has no words: it fails few_words. Repeated rows are judged
    each; empty input gives empty output; extra columns pass only if named in keep.
    """
    m = measured(docs, text_col, keep, lang_col)
    reasons = F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in (*BASE, *rules))))
    out = m.select("*", _any(BASE).alias("base_failed"), reasons.alias("reasons"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))


def _any(rules) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | r.fails()
    return out


def filtered(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, lang_col: str | None = "lang") -> DataFrame:
    """The rows of docs that are kept, with all and only their own columns."""
    keep = docs.columns
    renamed = docs.toDF(*(f"_c{i}" for i in range(len(keep))))
    # the row number keeps the filter above the projections: pushed down, it would work every measure out again for each use
    lang = f"_c{keep.index(lang_col)}" if lang_col in keep else None
    out = judged(renamed, f"_c{keep.index(text_col)}", renamed.columns, rules, lang).withColumn("_row", F.monotonically_increasing_id()).where("kept and _row >= 0")
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)))
