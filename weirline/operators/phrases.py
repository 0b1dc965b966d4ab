"""Listed phrases in texts: one automaton over tokens or subword pieces, or an equi-join of token n-grams where the list is too long to ship."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.functions import text as X

#: Bytes of phrases, as tokens, that are shipped to the tasks at most; longer lists are joined.
SHIPPED = 64 << 20


def patterns(tokens: DataFrame) -> DataFrame:
    """(pattern): the different phrases of tokens (tokens), as they are and in lower case; blank ones are none."""
    both = tokens.select(F.explode(F.array("tokens", F.lower("tokens"))).alias("pattern"))
    return both.where(F.trim("pattern") != "").distinct()


def shippable(found: DataFrame) -> bool:
    return (found.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0) <= SHIPPED


def matched(tokens: Column, listed: list[str]) -> Column:
    """The different listed patterns that stand in a text's tokens, as they are or in lower case, without the outer spaces, sorted.

    All patterns are one automaton (Aho-Corasick), so that a text's cost is its length and
    its hits, however many phrases there are.
    """

    def make():
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in listed:
            automaton.add_word(p, p.strip())
        if listed:
            automaton.make_automaton()

        def found(t: str) -> list[str]:
            both = (t, low) if (low := t.lower()) != t else (t,) if t else ()
            return sorted({p for x in both for _, p in automaton.iter(x)}) if listed else []

        return found

    run = X.by_value(make, "array<string>", pa.list_(pa.string()))
    return run(F.coalesce(tokens, F.lit("")))


def matched_by_join(df: DataFrame, key: str, tokens: str, listed: DataFrame) -> DataFrame:
    """(key, pattern) of the different listed patterns in each row's tokens: n-grams of the lengths that the list has, equi-joined to it.

    For lists of any size; key names a row. Lengths are a few numbers.
    """
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    p = listed.select(F.array_join(words("pattern"), " ").alias("gram"), F.size(words("pattern")).alias("n")).distinct()
    lengths = sorted(r.n for r in p.select("n").distinct().collect())
    each = df.select(F.col(key).alias("key"), F.explode(F.array(F.col(tokens), F.lower(tokens))).alias("t")).distinct().select("key", words("t").alias("w"))

    def starts(n: int) -> Column:
        all_n = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: i <= F.size("w") - n + 1)
        return F.transform(all_n, lambda i: F.struct(i.alias("i"), F.lit(n).alias("n")))

    grams = each.where(F.size("w") > 0).select("key", "w", F.explode(F.flatten(F.array(*map(starts, lengths)))).alias("s")).select("key", F.array_join(F.slice("w", F.col("s.i"), F.col("s.n")), " ").alias("gram"))
    return grams.join(p.select("gram"), "gram").select(F.col("key").alias(key), F.col("gram").alias("pattern")).distinct()


def with_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, out: str = "phrases") -> DataFrame:
    """df with the phrases of a table (phrase) that stand in a text as whole tokens: its tokens or theirs in lower case count too.

    key names a row; it is only used where the list is too long to ship.
    """
    listed = patterns(phrases.select(X.toxic_tokens(F.col("phrase")).alias("tokens")))
    if shippable(listed):
        return df.withColumn(out, matched(X.toxic_tokens(F.col(text)), [r.pattern for r in listed.orderBy("pattern").collect()]))
    found = matched_by_join(df.select(key, X.toxic_tokens(F.col(text)).alias("_t")), key, "_t", listed)
    found = found.groupBy(F.col(key).alias("_k")).agg(F.array_sort(F.collect_set("pattern")).alias(out))
    return df.join(found, df[key].eqNullSafe(found._k), "left").drop("_k").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))


def pieces(text: Column, model: str) -> Column:
    """Subword pieces of texts (Unicode punctuation replaced) by a SentencePiece model file, spaces between and around them."""
    with open(model, "rb") as f:
        data = f.read()

    def make():
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data)
        return lambda t: f" {' '.join(' '.join(sp.EncodeAsPieces(t)).split())} "

    run = X.by_value(make, "string", pa.string())
    return run(F.trim(X.replace_unicode_punct(F.coalesce(text, F.lit("")))))


def with_piece_phrases(df: DataFrame, text: str, phrases: DataFrame, model: str, out: str = "phrases") -> DataFrame:
    """df with the phrases (phrase) whose subword pieces stand in a text's pieces one after the other."""
    listed = patterns(phrases.select(pieces(F.col("phrase"), model).alias("tokens")))
    if not shippable(listed):
        raise ValueError(f"over {SHIPPED} bytes of phrases: cut the list into several")
    return df.withColumn(out, matched(pieces(F.col(text), model), [r.pattern for r in listed.orderBy("pattern").collect()]))
