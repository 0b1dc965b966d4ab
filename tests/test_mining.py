import numpy as np
import pandas as pd
import pytest

from weirline.operators import ivfpq, mining, topk


@pytest.fixture(scope="module")
def clustered(spark):
    """6,000 unit vectors of 32 dimensions about 60 centres, and their matrix."""
    r = np.random.default_rng(3)
    centres = r.normal(size=(60, 32))
    x = centres[r.integers(0, 60, 6000)] + 0.35 * r.normal(size=(6000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>").repartition(5).cache()
    yield df, x
    df.unpersist()


@pytest.fixture(scope="module")
def trained(clustered):
    return ivfpq.train(clustered[0], "OPQ16,IVF64,PQ16")


def pairs(df):
    return {(r.q_id, r.b_id) for r in df.collect()}


def exact_pairs(x, queries, k):
    near = np.argsort(-(x[queries] @ x.T), axis=1, kind="stable")[:, :k]
    return {(int(q), int(b)) for q, row in zip(queries, near) for b in row}


def test_recall_at_an_eighth_of_the_cells(clustered, trained):
    df, x = clustered
    codes = ivfpq.populate(df, trained).cache()
    assert codes.count() == len(x) and codes.select("cell").distinct().count() == 64
    q = df.where("id % 50 = 0")
    want = exact_pairs(x, np.arange(0, 6000, 50), 4)
    found = ivfpq.search(q, df, codes, trained, 4, nprobe=8)
    assert len(pairs(found) & want) >= 0.9 * len(want)
    few = pairs(ivfpq.search(q, df, codes, trained, 4, nprobe=8, rerank=1))
    assert len(few & want) < len(pairs(found) & want)  # codes alone rank less well
    sims = {(r.q_id, r.b_id): r.sim for r in found.collect()}
    assert all(abs(s - x[a] @ x[b]) < 1e-9 for (a, b), s in sims.items())
    tiled = pairs(ivfpq.search(q, df, codes.where("id % 2 = 0").union(codes.where("id % 2 = 1")), trained, 4, nprobe=8, block=50))
    assert tiled == pairs(found)


def test_model(spark, clustered, trained, tmp_path):
    df, x = clustered
    assert np.allclose(trained.rotation @ trained.rotation.T, np.eye(32))
    y = x @ trained.rotation
    at = trained.nearest_cells(y)[:, 0]
    assert (at == ((y[:, None] - trained.cells[None]) ** 2).sum(2).argmin(1)).all()
    rest = y - trained.cells[at]
    near = trained.decode(trained.encode(rest))
    assert ((rest - near) ** 2).sum() < 0.25 * (rest**2).sum()
    q, table = y[:3], trained.tables(y[:3])
    codes = trained.encode(rest[:5])
    by_table = np.stack([table[:, m, codes[:, m]] for m in range(codes.shape[1])]).sum(0)
    assert np.allclose(by_table, q @ trained.decode(codes).T)
    ivfpq.save(spark, trained, f"{tmp_path}/model")
    again = ivfpq.load(spark, f"{tmp_path}/model")
    assert all(np.array_equal(getattr(again, k), getattr(trained, k)) for k in ("rotation", "cells", "codebooks"))


def test_rotation_lessens_the_error_of_codes(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 8)) * [8, 8, 4, 4, 1, 1, 0.1, 0.1] @ np.linalg.qr(r.normal(size=(8, 8)))[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vec array<double>")

    def error(kind):
        m = ivfpq.train(df, kind, rounds=4)
        rest = x @ m.rotation
        rest = rest - m.cells[m.nearest_cells(rest)[:, 0]]
        return ((rest - m.decode(m.encode(rest))) ** 2).sum()

    assert error("OPQ2,IVF1,PQ2") < 0.9 * error("IVF1,PQ2")


def test_cells_are_as_many_as_asked_and_used(clustered):
    df, x = clustered
    c = ivfpq.lloyd(df, np.repeat(x[:1], 32, 0), np.eye(32), 6)
    assert len(np.unique(ivfpq.Index(np.eye(32), c, np.empty((0, 256, 0))).nearest_cells(x))) >= 30


def test_small_and_odd_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, None), (4, [1.0, 0.0, 0.0])], "id long, vec array<double>")
    m = ivfpq.train(df, "OPQ64,IVF8,PQ64", rounds=2)
    assert m.cells.shape == (3, 3) and m.codebooks.shape == (3, 256, 1)
    found = ivfpq.search(df.where("id = 1"), df, ivfpq.populate(df, m), m, 2, nprobe=8)
    assert [(r.b_id, r.rank) for r in found.orderBy("rank").collect()] == [(1, 1), (4, 2)]


def test_kinds():
    assert (ivfpq.index_type(10_000), ivfpq.index_type(10_001), ivfpq.index_type(600_000_000)) == ("Flat", "OPQ64,IVF1024,PQ64", "OPQ64,IVF262144,PQ64")
    assert ivfpq.n_cells("Flat") == 1 and ivfpq.n_cells(ivfpq.index_type(5_000_000)) == 32768
    assert ivfpq.n_parts("OPQ64,IVF1024,PQ64", 1024) == 64 and ivfpq.n_parts("OPQ64,IVF1024,PQ64", 96) == 48


def test_both_directions_equal_two_searches(clustered):
    df, _ = clustered
    a, b = df.where("id % 7 = 0"), df.where("id % 5 = 1")
    both = mining.knn_both(a, b, 3, block=200)
    row = lambda df: {(r.q_id, r.b_id, r["rank"], round(r.sim, 9)) for r in df.collect()}
    assert row(both.where("dir = 'f'")) == row(mining.knn(a, b, 3)) and row(both.where("dir = 'b'")) == row(mining.knn(b, a, 3))


def test_mining_takes_the_index_for_the_rows(clustered, monkeypatch):
    """Pairs of slightly turned copies are found by margin, through exact search and through an index alike."""
    df, x = clustered
    src, tgt = df.where("id < 2000"), df.where("id < 2000").selectExpr("id + 10000 as id", "transform(vec, (v, i) -> v + if(i = id % 32, 0.05D, 0D)) as vec")
    exact = mining.best_matches(mining.mine(src, tgt)).collect()
    true = {(r.src_id, r.tgt_id) for r in exact if r.tgt_id == r.src_id + 10000}
    assert len(true) > 1500
    asked = []
    monkeypatch.setattr(ivfpq, "index_type", lambda n: asked.append(n) or "OPQ16,IVF64,PQ16")
    found = {(r.src_id, r.tgt_id) for r in mining.best_matches(mining.mine(src, tgt, nprobe=8)).collect()}
    assert asked == [2000, 2000] and len(found & true) >= 0.95 * len(true)


def test_greatest_of_rows_against_sorting_all():
    r = np.random.default_rng(4)
    m = r.normal(size=(40, 700))
    m[:, r.integers(0, 700, 300)] = m[:, :1]  # many ties
    m[:, 650] = m[:, 20] + 3e-10  # alike in nine places
    sunk = np.where(r.random(m.shape) < 0.99, -np.inf, m)
    for x in (m, m.T, sunk, m.round(1), m[:, :5], m[:1, :1]):
        for k in (1, 4, 70):
            few = min(k, x.shape[1])
            want = np.argsort(-x.round(9), axis=1, kind="stable")[:, :few]
            w, i = topk.top(x, k)
            order = topk.leading(w, i, x[w, i], k)
            assert (i[order].reshape(-1, few) == want).all() and (w[order].reshape(-1, few) == np.arange(len(x))[:, None]).all()
            floor, parts = np.full(len(x), -np.inf), []
            for a in range(0, x.shape[1], 130):
                w, i = topk.top(x[:, a : a + 130], k, floor)
                parts.append((w, i + a))
            w, i = (np.concatenate(p) for p in zip(*parts))
            order = topk.leading(w, i, x[w, i], k)
            assert (i[order].reshape(-1, few) == want).all()


def test_slices_of_a_tile_keep_the_best_of_both_sides(clustered, monkeypatch):
    _, x = clustered
    side = lambda name, a, b: pd.DataFrame({f"{name}_id": np.arange(a, b), f"{name}_vec": list(x[a:b])}).sample(frac=1, random_state=1)
    sims = x[:900] @ x[5000:].T
    order = lambda m: np.argsort(-m.round(9), axis=1, kind="stable")[:, :4]
    want = {("f", q, 5000 + int(c)) for q, row in enumerate(order(sims)) for c in row} | {("b", 5000 + q, int(c)) for q, row in enumerate(order(sims.T)) for c in row}
    for most in (1 << 22, 50_000, 3_000):  # all rows of a side at once, 50, three
        monkeypatch.setattr(topk, "PRODUCTS", most)
        assert {(r.dir, r.q_id, r.b_id) for r in mining._tile_both(4)(side("q", 0, 900), side("b", 5000, 6000)).itertuples()} == want


def test_queries_with_sql_stay_exact_beyond_the_size_of_an_index(spark, tmp_path, monkeypatch):
    """With more rows than exact search is used for by default, the queries that have SQL still take all pairs."""
    from weirline.plans import registry

    monkeypatch.setattr(ivfpq, "train", lambda *a, **k: pytest.fail("an index was trained"))
    monkeypatch.setattr(ivfpq, "index_type", lambda n: "OPQ16,IVF64,PQ16")
    for name in ("vec_best_matches", "vec_pair_margins", "vec_margin_mining"):
        assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
