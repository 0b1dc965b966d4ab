import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.operators import scorer
from weirline.plans import registry

SCHEMA = "id int, s array<float>, m array<float>, r array<float>, y double"


def rows(n=40, dim=4, seed=1):
    g = np.random.default_rng(seed)
    out = []
    for i in range(n):
        s, m, r = (g.normal(size=dim).round(3).tolist() for _ in range(3))
        out.append((i, s, m, r, float(np.dot(s, m) / np.linalg.norm(s) / np.linalg.norm(m))))
    return out


def plain(model, s, m, r):
    """One row, component by component."""
    if model.normalised:
        s, m, r = ([x / sum(y * y for y in v) ** 0.5 for x in v] for v in (s, m, r))
    times = lambda a, b: [x * y for x, y in zip(a, b)]
    apart = lambda a, b: [abs(x - y) for x, y in zip(a, b)]
    x = {"qe": s + m + times(s, m) + apart(m, s), "comet": r + m + times(s, m) + times(r, m) + apart(m, s) + apart(m, r)}
    x["comet-src"] = s + x["comet"]
    x = x[model.form]
    for k, (w, b) in enumerate(model.layers):
        x = [sum(p * q for p, q in zip(row, x)) + c for row, c in zip(w, b)]
        if k < len(model.layers) - 1:
            x = [np.tanh(v) if model.activation == "TANH" else max(v, 0) for v in x]
    return np.tanh(x[0]) if model.bounded else x[0]


@pytest.mark.parametrize("form", list(scorer.FORMS))
@pytest.mark.parametrize("settings", [{}, {"activation": "RELU", "normalised": False, "bounded": True}])
def test_scores_against_a_plain_network(spark, form, settings):
    model = scorer.fresh(4, (5, 0, 3), form, seed=2, **settings)
    assert [w.shape for w, _ in model.layers] == [(5, 4 * scorer.FORMS[form]), (3, 5), (1, 3)]
    data = rows()
    got = spark.createDataFrame(data, SCHEMA).select("id", scorer.score(model, F.col("s"), F.col("m"), F.col("r")).alias("x")).collect()
    assert all(x.x == pytest.approx(plain(model, *data[x.id][1:4]), abs=1e-5) for x in got) and len(got) == len(data)
    again = scorer.Scorer.from_bytes(model.to_bytes())
    assert again.form == form and again.bounded == model.bounded and np.array_equal(again.flat(), model.flat())


def test_odd_rows_have_no_score(spark):
    v = [1.0, 2.0]
    odd = [(0, v, v, v, 0.5), (1, None, v, v, 0.5), (2, v, [1.0], v, 0.5), (3, v, v, [1.0, None], 0.5), (4, [], v, v, 0.5), (5, [0.0, 0.0], v, v, 0.5), (6, v, v, v, None), (7, v, v, v, float("nan")), (0, v, v, v, 0.5)]
    df = spark.createDataFrame(odd, SCHEMA).coalesce(1)
    model = scorer.fresh(2, (3,), seed=1)
    got = {x.id: x.x for x in df.select("id", scorer.score(model, F.col("s"), F.col("m"), F.col("r")).alias("x")).collect()}
    assert {i for i, x in got.items() if x is None} == {1, 2, 3, 4} and got[0] == got[6]
    same, errors = scorer.fit(df.where("id in (1, 2, 6, 7)"), model, "y", "s", "m", "r", rounds=3)
    assert errors == [] and np.array_equal(same.flat(), model.flat())
    assert scorer.fit(df.limit(0), model, "y", "s", "m", "r", rounds=3)[1] == []
    with pytest.raises(ValueError):
        scorer.score(model, F.col("s"), F.col("m"))
    with pytest.raises(ValueError):
        scorer.fresh(2, activation="STEP")


@pytest.mark.parametrize("settings", [{}, {"activation": "RELU"}, {"bounded": True}])
def test_gradient_is_the_slope(settings):
    model = scorer.fresh(3, (4, 2), "comet-src", seed=3, **settings)
    g = np.random.default_rng(4)
    x, y, w = g.normal(size=(6, 21)), g.normal(size=6), model.flat()
    got, error = model.gradient(x, y)
    at = lambda v: model.with_weights(v).gradient(x, y)[1]
    step = 1e-6
    for k in g.choice(len(w), 25, replace=False):
        d = np.zeros_like(w)
        d[k] = step
        assert got[k] == pytest.approx((at(w + d) - at(w - d)) / (2 * step), abs=1e-4)
    assert error == pytest.approx(((model.outputs(x)[-1][:, 0] - y) ** 2).sum())


def one_process(model, x, y, rounds, rate):
    """(weights, errors) of the same rounds over whole matrices."""
    w, m, v, errors = model.flat(), 0, 0, []
    for k in range(1, rounds + 1):
        g, e = model.with_weights(w).gradient(x, y)
        errors.append(e / len(y))
        g = g / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w, errors


def test_fitting_is_that_of_one_process(spark, monkeypatch):
    monkeypatch.setattr(scorer, "BLOCK", 7)  # many blocks
    data = rows(60)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    own = scorer.fresh(4, (6,), "qe", seed=1)
    model, errors = scorer.fit(df, own, "y", "s", "m", rounds=6, rate=0.02)
    x = own.features(*(np.array([d[k] for d in data], np.float32).astype(float) for k in (1, 2)))
    w, want = one_process(own, x, np.array([d[4] for d in data]), 6, 0.02)
    assert np.allclose(w, model.flat(), atol=1e-9) and np.allclose(errors, want) and errors[-1] < errors[0]


def test_a_learnable_score_holds_on_rows_not_seen(spark):
    df = spark.createDataFrame(rows(400), SCHEMA).repartition(3)
    model, _ = scorer.fit(df.where("id % 5 <> 0"), scorer.fresh(4, (), "qe", seed=5), "y", "s", "m", rounds=60, rate=0.05)
    held = df.where("id % 5 = 0").select("y", scorer.score(model, F.col("s"), F.col("m")).alias("x")).toPandas()
    assert len(held) == 80 and ((held.x - held.y) ** 2).mean() < 0.1 * held.y.var()


def test_query_is_that_of_one_process(spark, sf):
    got = registry.queries()["vec_fitted_scores"](spark, sf).toPandas().sort_values("vec_id").set_index("vec_id")
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().set_index("vec_id").embedding
    ids = [i for i in sorted(e.index) if i + 1 in e.index and i + 2 in e.index]
    assert list(got.index) == ids
    s, m, r = (np.array([e[i + k] for i in ids], np.float32).astype(float) for k in range(3))
    cos = lambda a, b: (a * b).sum(1) / np.linalg.norm(a, axis=1) / np.linalg.norm(b, axis=1)
    y, taught = (cos(s, m) + cos(m, r)) / 2, np.array(ids) % 5 != 0
    model = scorer.fresh(64, (), seed=5)
    x = model.features(s, m, r)
    w, _ = one_process(model, x[taught], y[taught], 30, 0.02)
    assert np.allclose(got.label, y, atol=1e-6) and np.allclose(got.score, model.with_weights(w).outputs(x)[-1][:, 0], atol=1e-5)
    assert list(got.held_out) == list(~taught)
