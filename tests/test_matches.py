import random

from weirline.operators import intervals, matching, ranks


def all_pairs(rows):
    """(pairs, concordant, discordant, x tied, y tied, both) by every pair of rows."""
    rows = [r for r in rows if None not in r]
    out = [0] * 6
    for k, (a, b) in enumerate(rows):
        for c, d in rows[:k]:
            sx, sy = (a > c) - (a < c), (b > d) - (b < d)
            for at, hit in enumerate((True, sx * sy > 0, sx * sy < 0, not sx, not sy, not sx and not sy)):
                out[at] += hit
    return out


def average(values):
    order = sorted(values)
    return [order.index(v) + (order.count(v) + 1) / 2 for v in values]


def test_rank_statistics_against_all_pairs(spark):
    r = random.Random(1)
    tables = [
        [(r.randint(0, 5), r.randint(0, 3)) for _ in range(300)],
        [(r.random(), r.random()) for _ in range(700)],
        [(0.0, r.random()) for _ in range(200)] + [(r.random(), k % 7 + 0.0) for k in range(400)],
        [(1.0, 2.0), (None, 1.0), (3.0, None)],
        [],
    ]
    for rows in tables:
        df = spark.createDataFrame([tuple(None if v is None else float(v) for v in x) for x in rows], "a double, b double").repartition(3)
        c = ranks.counted(df, "a", "b")
        p = ranks.pair_counts(c)
        want = all_pairs(rows)
        assert [p.pairs, p.concordant, p.discordant, p.x_tied, p.y_tied, p.both_tied] == want
        assert ranks.discordant(c, buckets=4) == want[2]
    x, y = zip(*tables[0])
    a, b = average(x), average(y)
    m = (len(x) + 1) / 2
    cov = lambda p, q: sum((s - m) * (t - m) for s, t in zip(p, q))
    c = ranks.counted(spark.createDataFrame([(float(s), float(t)) for s, t in tables[0]], "a double, b double"), "a", "b")
    assert abs(ranks.spearman(c).first()[0] - cov(a, b) / (cov(a, a) * cov(b, b)) ** 0.5) < 1e-9


def test_no_pairs_of_values_in_the_plan(spark):
    c = ranks.counted(spark.range(10).selectExpr("id as a", "id % 3 as b"), "a", "b")
    plan = ranks.spearman(c)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def greedy(pairs, near_i, near_j):
    """Take the best of what is left, strike what it conflicts with."""
    left, out = sorted((p for p in pairs if p[3] > 0), key=lambda p: (-p[3], p[1], p[2])), []
    for key in sorted({p[0] for p in left}):
        rest = [p for p in left if p[0] == key]
        while rest:
            _, i, j, s = rest[0]
            out.append((key, i, j, s))
            rest = [p for p in rest if p[1] != i and p[2] != j and (key, p[1], i) not in near_i and (key, p[2], j) not in near_j]
    return sorted(out)


def test_exclusive_matches_equal_the_loop(spark):
    r = random.Random(2)
    for n in (6, 40):
        sides = [[(key, k, float(s := r.randint(0, 300)), float(s + r.randint(1, 30))) for key in "ab" for k in range(n)] for _ in range(2)]
        pairs = [(key, i, j, r.choice([0.0, 0.1, 0.2, 0.5, round(r.random(), 3)])) for key in "ab" for i in range(n) for j in range(n) if r.random() < 0.4]
        near, sets = [], []
        for side in sides:
            df = spark.createDataFrame(side, "key string, id long, s double, e double")
            near.append(matching.symmetric(intervals.overlaps(df, "key", "id", "s", "e", 50.0)))
            sets.append({(a[0], a[1], b[1]) for a in side for b in side if a[0] == b[0] and a[1] != b[1] and a[2] < b[3] and b[2] < a[3]})
        got = matching.exclusive_matches(spark.createDataFrame(pairs, "key string, i long, j long, score double"), *near)
        assert sorted(map(tuple, got.collect())) == greedy(pairs, *sets)
    none = spark.createDataFrame([], "key string, i long, j long, score double")
    assert matching.exclusive_matches(none, *near).count() == 0


def walk(parent, targets, node, not_itself):
    """Up the tree, the heaviest target below, by a plain walk."""
    up, at = 0, node
    while at is not None:
        below = []
        for t, w in targets.items():
            x = t
            while x is not None and x != at:
                x = parent.get(x)
            if x == at and not (not_itself and t == node):
                below.append((-w, t))
        if below:
            return min(below)[1], up
        at, up = parent.get(at), up + 1
    return None


def test_nearest_relatives_against_a_walk(spark):
    import pytest

    from weirline.operators import family

    r = random.Random(3)
    parent = {"n00": None} | {f"n{k:02}": f"n{r.randrange(max(0, k - 6), k):02}" for k in range(1, 48)} | {"o1": None, "o2": "o1"}
    targets = {n: float(r.randint(1, 3)) for n in r.sample(sorted(parent), 9) if n[0] == "n"}
    nodes = spark.createDataFrame(list(parent.items()), "id string, parent string")
    df = spark.createDataFrame(list(targets.items()), "id string, weight double")
    for own in (False, True):
        got = {x.id: (x.relative, x.up) for x in family.nearest_relatives(nodes, df, own).collect()}
        assert got == {n: w for n in parent if (w := walk(parent, targets, n, own))}
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string")
    with pytest.raises(ValueError):
        family.DEEPEST, deepest = 4, family.DEEPEST
        try:
            family.ancestors(circle)
        finally:
            family.DEEPEST = deepest


def test_forced_alignment(spark):
    import numpy as np

    from weirline.operators import sequences as S

    r = np.random.default_rng(6)
    soft = lambda x: [np.exp(v - max(v)) / sum(np.exp(v - max(v))) for v in x]
    for n, m in ((1, 1), (3, 5), (6, 4), (4, 4)):
        for _ in range(5):
            of_a, of_b = sorted([*range(n), *r.integers(0, n, 2).tolist()]), sorted([*range(m), *r.integers(0, m, 3).tolist()])
            a, b = r.normal(size=(len(of_a), 6)), r.normal(size=(len(of_b), 6))
            s = a @ b.T
            rows, cols = np.array(soft(s)), np.array(soft(s.T)).T
            sure = {(of_a[i], of_b[j]) for i in range(len(of_a)) for j in range(len(of_b)) if rows[i, j] > 0.2 and cols[i, j] > 0.2}
            rows, cols = np.array(soft(s * 1e-3)), np.array(soft((s * 1e-3).T)).T
            free_a, free_b, extra = set(range(n)) - {i for i, _ in sure}, set(range(m)) - {j for _, j in sure}, set()
            while free_a or free_b:
                ways = [(rows[i, j], 1, -i, -j) for i in range(len(of_a)) for j in range(len(of_b)) if of_a[i] in free_a]
                back = [(cols[i, j], 2, -i, -j) for i in range(len(of_a)) for j in range(len(of_b)) if of_b[j] in free_b]
                _, _, i, j = max(ways + back)
                extra.add((of_a[-i], of_b[-j]))
                free_a, free_b = free_a - {of_a[-i]}, free_b - {of_b[-j]}
            got = S.align_forced(a, b, of_a, of_b, 0.2)
            assert got == (sure, extra)
            assert {i for i, _ in sure | extra} == set(range(n)) and {j for _, j in sure | extra} == set(range(m))
    assert S.align_forced(np.empty((0, 6)), np.ones((1, 6)), [], [0]) == (set(), set())
