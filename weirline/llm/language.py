"""Language identification: nearest of several clustered centroids per language over TF-IDF byte n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the labelled sample: rows per language, whole texts.
SAMPLE = 300
CENTROIDS = 4
BITS = 12
DIM = 1 << BITS
ROUNDS = 12
#: A text farther from its centroid than this share of the worst learned row's cosine is rejected.
REJECT = 0.5
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.full(256, 32, np.uint8)
_KEEP[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_KEEP[128:] = np.arange(128, 256)


def counts(text: str) -> np.ndarray:
    """Counts of hashed byte 1- to 3-grams of the lower-cased letters; all else counts as a space."""
    b = _KEEP[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    mix, shift = np.uint32(2654435761), np.uint32(32 - BITS)
    out = np.bincount(three * mix >> shift, minlength=DIM)
    out += np.bincount((two + np.uint32(1 << 25)) * mix >> shift, minlength=DIM)
    out += np.bincount((b + np.uint32(1 << 26)) * mix >> shift, minlength=DIM)
    return out


@dataclass
class Model:
    """Unit centroids (rows), the language of each, the least cosine accepted there, and the IDF weights."""

    langs: list[str]
    centroids: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        v = np.log1p(rows.astype(np.float32)) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cos = self.vectors(rows) @ self.centroids.T
        best = cos.argmax(1)
        return best, np.clip(cos[np.arange(len(rows)), best], 0, 1)


def cluster(v: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; fewer centroids where there are fewer distinct rows."""
    seeds = [0]
    while len(seeds) < min(k, len(v)):
        near = (v @ v[seeds].T).max(1)
        if near.min() > 1 - 1e-6:
            break
        seeds.append(int(near.argmin()))
    c = v[seeds].copy()
    for _ in range(rounds):
        at = (v @ c.T).argmax(1)
        for i in range(len(c)):
            if (at == i).any():
                m = v[at == i].sum(0)
                c[i] = m / max(float(np.linalg.norm(m)), 1e-12)
    return c


def _counted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = [], []
            for t in b.column(1):
                c = counts(t.as_py())
                i = np.flatnonzero(c)
                at.append(i.astype(np.int16))
                n.append(c[i].astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int16())), pa.array(n, pa.list_(pa.int32()))], names=["lang", "at", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, at array<smallint>, n array<int>")


def fit(labelled: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from at most `sample` rows per language, those first by hash of id; rows without text, letter or language are left out."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit(11)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not n:
        return Model([], np.zeros((0, DIM), np.float32), np.zeros(0), np.ones(DIM, np.float32))
    # a hash cut well above the sample first, so that no task sorts a language
    share = rows.sparkSession.createDataFrame([(k, min(1.0, 4 * (sample + 25) / v)) for k, v in n.items()], "lang string, share double")
    cut = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20))
    first = cut.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("r") <= sample)
    got = sorted(((r.lang, r.at, r.n) for r in _counted(first).collect()), key=lambda r: (r[0], r[1], r[2]))
    m = np.zeros((len(got), DIM), np.int32)
    for i, (_, at, k) in enumerate(got):
        m[i, at] = k
    langs = np.array([g[0] for g in got])
    idf = (np.log((1 + len(m)) / (1 + (m > 0).sum(0))) + 1).astype(np.float32)
    model = Model([], np.zeros((0, DIM), np.float32), np.zeros(0), idf)
    v, parts, least = model.vectors(m), [], []
    for lang in sorted(set(langs.tolist())):
        own = v[langs == lang]
        c = cluster(own)
        cos = own @ c.T
        at = cos.argmax(1)
        least += [float(cos[at == i, i].min()) if (at == i).any() else 1.0 for i in range(len(c))]
        model.langs += [lang] * len(c)
        parts.append(c)
    model.centroids, model.least = np.concatenate(parts), np.array(least)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang, score, rejected) of whole texts: the nearest centroid's language and its cosine.

    `und` with score 0 where text is null or has no letter, or nothing was learned.
    rejected: no letter, or a cosine under REJECT times the least learned for that
    centroid. One map stage; rows never meet. Ids may repeat or be null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                texts = b.column(1).to_pylist()
                use = [i for i, t in enumerate(texts) if t and model.langs and _LETTER.search(t)]
                lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                if use:
                    best, cos = model.nearest(np.stack([counts(texts[i]) for i in use]))
                    score[use], rejected[use] = cos, cos < REJECT * model.least[best]
                    for i, k in zip(use, best.tolist()):
                        lang[i] = model.langs[k]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["id", "lang", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang string, score double, rejected boolean")
