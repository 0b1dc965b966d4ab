"""A supervised scorer of translations: crossed features of sentence vectors through a small network.

Scores are matrix products over Arrow batches. Fitting makes one Spark job a round: tasks
sum gradients of their rows, the sums meet by blocks of the weights, and only one gradient,
of the size of the model, comes to the driver.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a row of features is made of.
FORMS = {"comet": 6, "comet-src": 7, "qe": 4}
ACTIVATIONS = {"TANH": (np.tanh, lambda a: 1 - a * a), "RELU": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float))}
#: Weights in a row of the gradients that tasks exchange.
BLOCK = 4096


@dataclass(frozen=True)
class Scorer:
    """Layers (weights of out x in, biases), all but the last followed by the activation; bounded: a tanh after the last."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]
    form: str = "comet"
    activation: str = "TANH"
    normalised: bool = True
    bounded: bool = False

    def __post_init__(self) -> None:
        if self.form not in FORMS or self.activation not in ACTIVATIONS:
            raise ValueError(f"no form {self.form} or activation {self.activation}")

    @property
    def dim(self) -> int:
        return self.layers[0][0].shape[1] // FORMS[self.form]

    def features(self, src: np.ndarray, mt: np.ndarray, ref: np.ndarray | None = None) -> np.ndarray:
        """Rows of the network's input. With a reference: reference, translation, their products and distances, those with
        the source between; comet-src puts the source first; qe has source and translation only."""
        if self.normalised:
            src, mt, ref = (None if v is None else v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (src, mt, ref))
        if self.form == "qe":
            return np.concatenate([src, mt, src * mt, np.abs(mt - src)], 1)
        ahead = [src] if self.form == "comet-src" else []
        return np.concatenate([*ahead, ref, mt, src * mt, ref * mt, np.abs(mt - src), np.abs(mt - ref)], 1)

    def outputs(self, x: np.ndarray) -> list[np.ndarray]:
        """The input and what each layer makes of it."""
        act, out = ACTIVATIONS[self.activation][0], [x]
        for k, (w, b) in enumerate(self.layers):
            z = out[-1] @ w.T + b
            out.append(act(z) if k < len(self.layers) - 1 else np.tanh(z) if self.bounded else z)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        """Sums over rows of the gradient of the squared error, flat, and of the error."""
        slope, out = ACTIVATIONS[self.activation][1], self.outputs(x)
        error = out[-1][:, 0] - y
        back = 2 * error[:, None] * ((1 - out[-1] ** 2) if self.bounded else 1)
        parts: list[np.ndarray] = []
        for k in range(len(self.layers) - 1, -1, -1):
            parts[:0] = [(back.T @ out[k]).ravel(), back.sum(0)]
            if k:
                back = (back @ self.layers[k][0]) * slope(out[k])
        return np.concatenate(parts), float(error @ error)

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for layer in self.layers for v in layer])

    def with_weights(self, flat: np.ndarray) -> Scorer:
        layers, at = [], 0
        for w, b in self.layers:
            layers.append((flat[at : at + w.size].reshape(w.shape), flat[at + w.size : at + w.size + b.size]))
            at += w.size + b.size
        return replace(self, layers=tuple(layers))

    def to_bytes(self) -> bytes:
        """The whole model: settings and weights as an .npz."""
        kept = {"form": self.form, "activation": self.activation, "normalised": self.normalised, "bounded": self.bounded}
        out = io.BytesIO()
        np.savez(out, settings=np.frombuffer(json.dumps(kept).encode(), np.uint8), **{f"{kind}{k}": v for k, layer in enumerate(self.layers) for kind, v in zip("wb", layer)})
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> Scorer:
        got = np.load(io.BytesIO(data))
        layers = tuple((got[f"w{k}"], got[f"b{k}"]) for k in range((len(got.files) - 1) // 2))
        return Scorer(layers, **json.loads(got["settings"].tobytes()))


def fresh(dim: int, hidden: tuple[int, ...] = (64,), form: str = "comet", seed: int = 0, **settings) -> Scorer:
    """A scorer of even random weights within one over the root of each layer's inputs; hidden widths of zero are left out."""
    rng, layers = np.random.default_rng(seed), []
    widths = [FORMS[form] * dim, *(h for h in hidden if h > 0), 1]
    for n, m in zip(widths, widths[1:]):
        layers.append((rng.uniform(-1, 1, (m, n)) / np.sqrt(n), rng.uniform(-1, 1, m) / np.sqrt(n)))
    return Scorer(tuple(layers), form, **settings)


def whole_vectors(dim: int, columns: list[pa.Array]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, matrices): places of the rows whose vectors all have dim components and no null, and these rows' vectors."""
    ok = np.ones(len(columns[0]), bool)
    for c in columns:
        ok &= pc.fill_null(pc.equal(pc.list_value_length(c), dim), False).to_numpy(zero_copy_only=False)
        holes = pc.list_parent_indices(c).filter(pc.is_null(pc.list_flatten(c))) if c.flatten().null_count else pa.array([], pa.int64())
        ok[holes.to_numpy()] = False
    rows = np.flatnonzero(ok)
    return rows, [c.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), dim) for c in columns]


def score(model: Scorer, src: Column, mt: Column, ref: Column | None = None) -> Column:
    """The score of each row's vectors; null where one is null, has a null component or another dimension than the model's."""
    if ref is None and model.form != "qe":
        raise ValueError(f"{model.form} needs a reference")
    data, dim = model.to_bytes(), model.dim

    @F.arrow_udf("double")
    def run(cols: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        own = Scorer.from_bytes(data)
        for c in cols:
            rows, vectors = whole_vectors(dim, list(c))
            out = np.full(len(c[0]), np.nan)
            out[rows] = own.outputs(own.features(*vectors))[-1][:, 0]
            missing = np.ones(len(out), bool)
            missing[rows] = False
            yield pa.array(out, mask=missing)

    return run(src, mt) if model.form == "qe" else run(src, mt, ref)


def _gradients(df: DataFrame, model: Scorer, columns: list[str], label: str) -> DataFrame:
    """(block, values): sums of gradients by block of the weights; the last block holds rows and error."""
    data, dim, n = model.to_bytes(), model.dim, len(columns)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scorer.from_bytes(data)
        total, seen = np.zeros(len(own.flat())), np.zeros(2)
        for b in batches:
            rows, vectors = whole_vectors(dim, b.columns[:n])
            y = b.column(n).to_numpy(zero_copy_only=False)[rows]
            known = np.isfinite(y)
            g, error = own.gradient(own.features(*(v[known] for v in vectors)), y[known])
            total += g
            seen += known.sum(), error
        parts = [total[k : k + BLOCK] for k in range(0, len(total), BLOCK)] + [seen]
        yield _blocks(range(len(parts)), parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                x = v.values.to_numpy()
                sums[k] = sums[k] + x if k in sums else x.copy()
        yield _blocks(sums.keys(), list(sums.values()))

    shape = "block int, values array<double>"
    rows = df.select(*columns, F.col(label).cast("double").alias("label"))
    return rows.mapInArrow(each, shape).repartition("block").mapInArrow(summed, shape)


def _blocks(names, parts: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(names), pa.int32()), pa.array(parts, pa.list_(pa.float64()))], names=["block", "values"])


def fit(df: DataFrame, model: Scorer, label: str, src: str, mt: str, ref: str | None = None, rounds: int = 60, rate: float = 0.01) -> tuple[Scorer, list[float]]:
    """(model, errors): weights after rounds of adaptive moments on the mean squared error over all rows, and each round's error.

    Rows that score() gives null, and those without a finite label, teach nothing. Without
    any other row the model is returned as it is.
    """
    columns = [src, mt] if model.form == "qe" else [src, mt, ref]
    w = model.flat()
    m, v, errors = np.zeros_like(w), np.zeros_like(w), []
    for k in range(1, rounds + 1):
        got = sorted(_gradients(df, model.with_weights(w), columns, label).collect())  # one gradient
        if not got or not (rows := got[-1]["values"][0]):
            break
        g = np.concatenate([r["values"] for r in got[:-1]]) / rows
        errors.append(got[-1]["values"][1] / rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return model.with_weights(w), errors
