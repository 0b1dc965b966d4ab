"""Interval joins by buckets, and gaps-and-islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(df: DataFrame, key: str, id_col: str, start: str, end: str, width: float) -> DataFrame:
    """(key, a, b, overlap) of intervals of one key that overlap, a < b.

    Intervals are dealt to every bucket of `width` they touch and meet by equality of key
    and bucket; a pair counts in the bucket where the later of both starts lies.
    """
    cut = df.select(key, id_col, start, end, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_b"))
    a, b = cut.toDF(key, "a", "a_s", "a_e", "_b"), cut.toDF(key, "b", "b_s", "b_e", "_b")
    later = F.greatest("a_s", "b_s")
    both = a.join(b, [key, "_b"]).where("a < b and a_s < b_e and b_s < a_e").where(F.floor(later / width) == F.col("_b"))
    return both.select(key, "a", "b", (F.least("a_e", "b_e") - later).alias("overlap"))


def islands(df: DataFrame, key: str, order: list, gap) -> DataFrame:
    """Adds island: a running number of the groups that `gap` (a condition of a row against the one before) starts."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_new", gap(w).cast("int")).withColumn("island", F.sum(F.coalesce("_new", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def frame_segments(frames: DataFrame, key: str, time: str, token: str, label: str, score: str) -> DataFrame:
    """(key, segment, label, start, end, score): frames of a key, in order of time, with runs of one token merged.

    end is the time after the last frame, score the mean over the frames with one. Two runs of
    a token with another between them stay two; a null token is a token like any other.
    """
    gap = lambda w: ~F.col("token").eqNullSafe(F.lag("token").over(w)) & F.lag(F.lit(1)).over(w).isNotNull()
    runs = islands(frames.select(F.col(key).alias("key"), F.col(time).alias("time"), F.col(token).alias("token"), F.col(label).alias("label"), F.col(score).alias("score")), "key", ["time"], gap)
    return runs.groupBy("key", F.col("island").alias("segment")).agg(F.min_by("label", "time").alias("label"), F.min("time").alias("start"), (F.max("time") + 1).alias("end"), F.avg("score").alias("score"))


def segment_words(segments: DataFrame, separator: str, fps: float = 1.0) -> DataFrame:
    """(key, word, text, start, end) of frame_segments(): labels joined up to each separator, times in seconds.

    A key with n separators has n + 1 words; one without a label has an empty text and -1 as start and end.
    """
    w = Window.partitionBy("key").orderBy("segment")
    cut = F.coalesce((F.col("label") == separator), F.lit(False))
    # a separator is the last segment of the word before it; the key's last word may have no segment
    word = F.coalesce(F.sum(cut.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.lead("segment").over(w).isNull()
    s = segments.withColumn("word", word).withColumn("cut", cut).withColumn("ends", cut & last)
    parts = F.transform(F.sort_array(F.collect_list(F.when(~F.col("cut"), F.struct("segment", "label")))), lambda x: F.coalesce(x["label"], F.lit("")))
    own = lambda f, c: F.coalesce(f(F.when(~F.col("cut"), F.col(c))) / fps, F.lit(-1.0))
    words = s.groupBy("key", "word").agg(F.array_join(parts, "").alias("text"), own(F.min, "start").alias("start"), own(F.max, "end").alias("end"), F.max("ends").alias("_ends"))
    each = F.when(F.col("_ends"), F.array(F.struct("word", "text", "start", "end"), F.struct((F.col("word") + 1).alias("word"), F.lit("").alias("text"), F.lit(-1.0).alias("start"), F.lit(-1.0).alias("end")))).otherwise(F.array(F.struct("word", "text", "start", "end")))
    return words.select("key", F.explode(each).alias("w")).select("key", "w.*")
