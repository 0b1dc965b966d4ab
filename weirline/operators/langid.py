"""Language identification by a trained model: naive Bayes over letter trigrams, with a threshold for each label."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirline.functions.text import HELD, by_value

#: Letters of a gram; three fit into one 64-bit number.
GRAM = 3
#: Different (label, gram) counts of a model at most; it is shipped to the tasks.
LARGEST = 4_000_000


def letters(t: Column) -> Column:
    """Lower-case words of letters, single spaces between and around them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(t), "[^\\p{L}]+", " ")), F.lit(" "))


def codes(text: str) -> np.ndarray:
    """The grams of cleaned text as numbers."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) >= GRAM else np.empty(0, np.int64)


@dataclass(frozen=True)
class Model:
    """Labels, sorted grams, log-probabilities (grams, labels), and those of a gram the model does not have."""

    labels: list[str]
    known: np.ndarray
    logs: np.ndarray
    other: np.ndarray

    def scores(self, text: str) -> np.ndarray | None:
        """Log-likelihoods of cleaned text by label, over its grams; None without a letter."""
        own, n = np.unique(codes(text), return_counts=True)
        if not text.strip() or not len(own) or not self.labels:
            return None
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        hit = self.known[at] == own if len(self.known) else np.zeros(len(own), bool)
        return n[hit] @ self.logs[at[hit]] + n[~hit].sum() * self.other


def train(labelled: DataFrame, text: str, label: str, least: int = 5) -> Model:
    """The model of all labelled rows: grams that a label has at least `least` times, one added to every count."""
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("label"), letters(F.col(text)).alias("x"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[str, list] = {}
            for some in (b.slice(a, HELD) for a in range(0, b.num_rows, HELD)):
                for name in some.column(0).unique().to_pylist():
                    own = [codes(x) for k, x in zip(some.column(0).to_pylist(), some.column(1).to_pylist()) if k == name]
                    found.setdefault(name, []).append(np.unique(np.concatenate(own), return_counts=True))
            for name, parts in found.items():
                gram, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(gram), pa.string()), pa.array(gram), pa.array(n)], names=["label", "gram", "n"])

    counts = rows.mapInArrow(count, "label string, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= least).limit(LARGEST + 1).toArrow()
    if kept.num_rows > LARGEST:
        raise ValueError(f"more than {LARGEST} grams: raise least ({least})")
    labels = sorted(set(kept.column("label").to_pylist()))
    known, at = np.unique(kept.column("gram").to_numpy(), return_inverse=True)
    n = np.zeros((len(known), len(labels)))
    n[at, [labels.index(x) for x in kept.column("label").to_pylist()]] = kept.column("n").to_numpy()
    total = n.sum(0) + len(known)
    return Model(labels, known, np.log((n + 1) / total), np.log(1 / total) if len(labels) else np.zeros(0))


def predicted(t: Column, model: Model) -> Column:
    """struct(label, prob, margin): the likeliest label, its posterior probability, and by how much a gram it leads on average; null without a letter."""
    kind = pa.struct([("label", pa.string()), ("prob", pa.float64()), ("margin", pa.float64())])

    def scored(x: str) -> dict | None:
        if (s := model.scores(x)) is None:
            return None
        order = np.argsort(-s, kind="stable")
        lead = float(s[order[0]] - s[order[1]]) if len(s) > 1 else 0.0
        return {"label": model.labels[order[0]], "prob": float(1 / np.exp(s - s[order[0]]).sum()), "margin": lead / max(1, len(x) - (GRAM - 1))}

    run = by_value(lambda: scored, "label string, prob double, margin double", kind)
    return run(letters(t))


def accepted(found: Column, label: Column, thresholds: dict[str, float], default: float = 0.5) -> Column:
    """Whether a prediction is the label, with at least the threshold of that label."""
    least = F.lit(default)
    for name, value in thresholds.items():
        least = F.when(label == name, F.lit(value)).otherwise(least)
    return F.coalesce((found["label"] == label) & (found["prob"] >= least), F.lit(False))
