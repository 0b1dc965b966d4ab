import hashlib
import math

import numpy as np

from weirline.llm import centroids as ct
from weirline.llm import queries


def plain(rows, dim, k=40, rounds=5):
    """Lloyd rounds over all distances in Python integers."""
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    ok.sort(key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [list(v) for _, v in ok[:k]]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        own = {}
        for _, v in ok:
            own.setdefault(best(v)[1], []).append(v)
        for n, vs in own.items():
            at[n] = [sum(x) // len(vs) for x in zip(*vs)]
    end = [(i, *best(v)) for i, v in ok]
    per = {}
    for _, d, n in end:
        per[n] = per.get(n, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, n, d, per[n], sum(per.values()), sha[n]) for i, d, n in end), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_plain_rounds(spark, sf):
    got = rows_of(queries.op11_centroids(spark, sf))
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got == plain(given, 64)


def test_odd_rows_ties_and_repeats(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 4) / 256]) for i in range(300)]
    rows += [(7, [0.5, 0.5, 0.5, 0.5]), (7, [0.5, 0.5, 0.5, 0.5]), (None, [0.25, 0.0, 0.0, 0.0])]
    odd = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 0.0, 0.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as v", "3 as cluster").repartition(3)
    assert rows_of(ct.report(*ct.cluster(df, dim=4))) == plain(rows + odd, 4)
    few = df.where("vec_id < 3")
    assert rows_of(ct.report(*ct.cluster(few, dim=4))) == plain(rows[:3], 4)
    assert ct.report(*ct.cluster(df.where("vec_id > 899"), dim=4)).count() == 0
    big = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.id for r in ct.cluster(big, dim=2)[0].collect()] == [2]


def test_bounds_hold_and_spare_checks():
    r = np.random.default_rng(2)
    centres = r.integers(-500, 500, (20, 16))
    v = centres[r.integers(0, 20, 2000)] + r.integers(-40, 40, (2000, 16))
    p = ct.Pivots.spread(centres)
    far = p.distances(v)
    low = p.bounds(np.sqrt(far), np.sqrt(p.distances(centres)))
    exact = ((v[:, None] - centres[None]) ** 2).sum(2)
    assert (low**2 <= exact).all()
    best, dist, checks = ct.nearest(v, far, centres, p)
    assert (best == exact.argmin(1)).all() and (dist == exact.min(1)).all()
    assert checks < 0.5 * exact.size
    same = ct.Pivots.spread(np.zeros((5, 16), np.int64))
    assert len(same.at) == 1 and (ct.nearest(v, same.distances(v), centres, same)[0] == exact.argmin(1)).all()
