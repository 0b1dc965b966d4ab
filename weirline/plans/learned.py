"""Queries of fitted models and optimal alignments, which have no SQL; tests hold them against plain versions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.functions import sentences as T
from weirline.functions import vectors as V
from weirline.operators import scorer
from weirline.operators import sequences as S
from weirline.plans.registry import query
from weirline.plans.strings import pairs

PLACES = "array<struct<i:int,j:int>>"


def _pairs(f):
    """f on two arrays of numbers of each row, as structs (i, j)."""

    @F.pandas_udf(PLACES)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([[{"i": i, "j": j} for i, j in f(np.asarray(x, float), np.asarray(y, float))] if len(x) and len(y) else [] for x, y in zip(a, b)])

    return run


def sentence_lengths(t) -> DataFrame:
    of = lambda c: F.transform(T.split_sentences(F.col(c)), lambda x: F.length(x).cast("double"))
    return pairs(t).select("conv_id", "turn", of("src").alias("a"), of("tgt").alias("b"))


@query()
def jn_optimal_assignment(t):
    """JN-14: sentences of both sides paired one to one with the least sum of differences in length."""
    find = _pairs(lambda a, b: S.assign(np.abs(a[:, None] - b[None, :])))
    return sentence_lengths(t).select("conv_id", "turn", F.explode(find("a", "b")).alias("p")).select("conv_id", "turn", "p.i", "p.j")


@query()
def jn_monotone_alignment(t):
    """JN-16: sentences of both sides paired in order with the highest sum of similarities of length."""
    find = _pairs(lambda a, b: S.monotone_pairs(1 / (1 + np.abs(a[:, None] - b[None, :]))))
    return sentence_lengths(t).select("conv_id", "turn", F.explode(find("a", "b")).alias("p")).select("conv_id", "turn", "p.i", "p.j")


@query()
def jn_monotone_inner(t):
    """JN-16: as jn_monotone_alignment, the walk back ended at the first sentence of either side."""
    find = _pairs(lambda a, b: S.monotone_pairs(1 / (1 + np.abs(a[:, None] - b[None, :])), stop_at_edge=True))
    return sentence_lengths(t).select("conv_id", "turn", F.explode(find("a", "b")).alias("p")).select("conv_id", "turn", "p.i", "p.j")


@query()
def udf_word_alignment(t):
    """UDF-13: word pairs by attention in both directions, eight words of eight numbers from each of two rows' vectors."""
    find = _pairs(lambda a, b: S.align_softmax(8 * a.reshape(-1, 8), 8 * b.reshape(-1, 8), 0.15))
    e = t("embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.explode(find("embedding", "other")).alias("p")).select("vec_id", "p.i", "p.j")


@query()
def udf_forced_alignment(t):
    """UDF-13: sure word pairs and a possible one for every other word: sixteen subwords of eight words from each of two rows' vectors."""
    words = [k // 2 for k in range(16)]

    @F.pandas_udf("array<struct<i:int,j:int,sure:boolean>>")
    def find(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            sure, possible = S.align_forced(8 * np.asarray(x).reshape(16, -1), 8 * np.asarray(y).reshape(16, -1), words, words, 0.15)
            out.append([{"i": i, "j": j, "sure": kind} for pairs, kind in ((sure, True), (possible, False)) for i, j in sorted(pairs)])
        return pd.Series(out, dtype=object)

    e = t("embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.explode(find("embedding", "other")).alias("p")).select("vec_id", "p.*")


@query()
def cnt_kmeans(t):
    """CNT-28: rows of each of eight k-means clusters of the vectors."""
    v = t("embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=8, seed=7, maxIter=20).fit(v)
    return model.transform(v).groupBy("prediction").agg(F.count("*").alias("n"))


def grouped_folds(df: DataFrame, group: str, features: list[str], label: str, folds: int = 4) -> DataFrame:
    """df with probability of the label 1 by logistic regression fitted on the other folds; a group is in one fold."""
    v = df.withColumn("_fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int")).withColumn("_x", array_to_vector(F.array(*(F.col(c).cast("double") for c in features))))
    out = None
    for k in range(folds):
        train, held = v.where(F.col("_fold") != k), v.where(F.col("_fold") == k)
        if held.isEmpty() or train.select(label).distinct().count() < 2:
            continue
        model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", maxIter=30, regParam=0.01).fit(train)
        one = model.transform(held).withColumn("probability", vector_to_array("_p")[1]).select(*df.columns, "probability")
        out = one if out is None else out.unionByName(one)
    return out


@query()
def udf_logistic_folds(t):
    """UDF-17: quality of documents from length and share of stop words, cross-validated by source."""
    d = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id").where("text is not null and source is not null")
    d = d.select("doc_id", "source", "quality", F.log1p("n_chars").alias("size"), T.language_share(F.col("text"), "en").alias("share"))
    return grouped_folds(d, "source", ["size", "share"], "quality").select("doc_id", F.round("probability", 6).alias("probability"))


def chained(t) -> DataFrame:
    """(vec_id, s, m, r): vectors of three rows that follow each other, as source, translation and reference."""
    e = t("embeddings").where(F.size("embedding") == 64)
    at = lambda k, n: e.select((F.col("vec_id") - k).alias("vec_id"), F.col("embedding").alias(n))
    return at(0, "s").join(at(1, "m"), "vec_id").join(at(2, "r"), "vec_id")


@query(
    """with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings where len(embedding) = 64), n as (select vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) as v from e),
f as (select a.vec_id, list_concat(a.v, b.v, list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]), list_transform(list_zip(a.v, b.v), lambda z: abs(z[2] - z[1]))) as f from n a join n b on b.vec_id = a.vec_id + 1 join n c on c.vec_id = a.vec_id + 2),
w as (select h, list(((h * 7 + k * 3) % 11 - 5) / 50 order by k) as w from range(2) a(h), range(256) b(k) group by h)
select vec_id, round(tanh(0.5 * tanh(list_dot_product(f, (select w from w where h = 0)) + 0.1) - 0.25 * tanh(list_dot_product(f, (select w from w where h = 1)) + 0.1) + 0.1), 6) as score from f"""
)
def vec_network_scores(t):
    """VEC-15: scores of a network of two hidden units with given weights, from source and translation, without a reference."""
    h, k = np.mgrid[:2, :256]
    layers = (((h * 7 + k * 3) % 11 - 5) / 50, np.full(2, 0.1)), (np.array([[0.5, -0.25]]), np.array([0.1]))
    model = scorer.Scorer(layers, "qe", bounded=True)
    return chained(t).select("vec_id", F.round(scorer.score(model, F.col("s"), F.col("m")), 6).alias("score"))


@query()
def vec_fitted_scores(t):
    """VEC-15, UDF-18: a scorer fitted on four fifths of all rows to the mean cosine with source and reference, and its scores of every row."""
    cosines = 0.5 * (V.cosine(F.col("s"), F.col("m")) + V.cosine(F.col("m"), F.col("r")))
    rows = chained(t).withColumn("label", cosines).withColumn("held_out", F.col("vec_id") % 5 == 0)
    model, _ = scorer.fit(rows.where("not held_out"), scorer.fresh(64, (), seed=5), "label", "s", "m", "r", rounds=30, rate=0.02)
    return rows.select("vec_id", "held_out", F.round("label", 6).alias("label"), F.round(scorer.score(model, F.col("s"), F.col("m"), F.col("r")), 6).alias("score"))
