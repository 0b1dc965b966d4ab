import numpy as np
import pytest

from weirline.operators import models
from weirline.operators import sequences as S


def test_overlap_goldens():
    assert S.overlap((0, 10), (15, 25)) == 0
    assert S.overlap((0, 10), (5, 17)) == pytest.approx(5 / 12)
    assert S.overlap((0, 10), (5, 17), "iou") == pytest.approx(5 / 17)


def test_suppress_golden(spark):
    rows = [(5.0, 10.0, 1.1), (6.0, 10.0, 1.2), (6.0, 11.0, 1.1)]
    assert [rows[i] for i in S.suppress(rows, 0.1)] == [(6.0, 10.0, 1.2)]
    df = spark.createDataFrame([("a", *r) for r in rows] + [("b", 0.0, 1.0, 0.5)], "key string, start double, end double, score double")
    assert sorted(r.score for r in S.suppress_groups(df, "key").collect()) == [0.5, 1.2]


def test_state_machines():
    no, yes = [False] * 6, [True] * 6
    assert S.capped_segments([9, 1, 3, 1, 5, 1], no, yes, 4) == [0, 0, 1, 1, 2, 2]
    assert S.capped_segments([9, 1, 3, 1, 5, 1], [False, True, False, False, True, False], no, 4) == [0, 1, 1, 1, 2, 2]
    assert S.capped_segments([0, 4, 0, 4], no, [False, False, True, True], 4) == [0, 0, 1, 2]
    assert S.divide(np.array([0.0, 0.9, 0.8, 0.1, 0.9, 0.9, 0.0]), 3, 1, 0.5) == [(1, 3), (4, 6)] and S.divide(np.zeros(4), 9, 1, 0.5) == [(0, 0)]
    assert S.candidate_spans([(0, 1), (2, 3), (9, 10)], 0.5, 4, 2) == [(0, 1), (0, 3), (2, 3), (9, 10)]
    lengths = [3, 1, 9, 2, 2]
    batches = S.padded_batches(lengths, 6)
    for b in set(batches):
        own = [n for n, k in zip(lengths, batches) if k == b]
        assert max(own) * len(own) <= 6 or len(own) == 1
    assert S.monotone_pairs(np.array([[0.9, 0.1], [0.8, 0.7]])) == [(0, 0), (1, 1)]


def test_assignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(4)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 6)):
        c = r.random((n, m)).round(1)
        got = S.assign(c)
        small, large = sorted((n, m))
        best = min(sum(c[(i, j) if n <= m else (j, i)] for i, j in zip(range(small), p)) for p in permutations(range(large), small))
        assert len(got) == small and sum(c[i, j] for i, j in got) == pytest.approx(best) and len({i for i, _ in got}) == len({j for _, j in got}) == small


def test_suppression_looks_at_the_last_kept_only():
    rows = [(0.0, 10.0, 5.0), (1.0, 4.0, 1.0), (8.0, 18.0, 6.0), (17.5, 30.0, 1.0)]
    assert S.suppress(rows, 0.1) == [2, 3] and S.suppress(rows, 0.5) == [0, 1, 2, 3]


def test_mapper_resumes_rebatches_and_infers(spark, tmp_path):
    from weirline.streaming.resume import Input, Output, rebatched, run_mapper

    import pandas as pd

    sizes = [len(b) for b in rebatched((pd.DataFrame({"i": range(n)}) for n in (3, 0, 5, 1, 9)), 4)]
    assert sizes == [4, 4, 4, 4, 2]
    source = Input(f"{tmp_path}/in", "i int, part int", where="i % 2 = 0", batch_size=7)
    for k in range(2):
        spark.range(k * 50, k * 50 + 50).selectExpr("cast(id as int) as i", "cast(id % 3 as int) as part").write.mode("append").parquet(f"{tmp_path}/in")
        run_mapper(spark, source, lambda b: b.assign(j=b["i"] * 2), Output(f"{tmp_path}/out", ("part",), 5), f"{tmp_path}/cp")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.i, r.j) for r in got.collect()) == [(i, 2 * i) for i in range(0, 100, 2)] and got.columns[-1] == "part"
    with pytest.raises(ValueError):
        models.infer_schema(spark.range(1), lambda b: None)
    total = models.map_reduce_lines(spark.range(10), lambda b: pd.DataFrame({"n": [len(b)]}), "n long", [S.F.sum("n").alias("n")])
    assert total.first().n == 10


def test_pauses_and_groups(spark):
    df = spark.createDataFrame([([0.0, 1.5, 2.0], [1.0, 1.95, 3.0]), ([0.0], [1.0])], "s array<double>, e array<double>")
    got = [[round(x, 3) for x in r.p] for r in df.select(S.pauses_after(S.F.col("s"), S.F.col("e")).alias("p")).collect()]
    assert got == [[0.5, 0.0], []]
    g = S.per_group(spark.createDataFrame([(1, 2), (1, 1)], "k int, v int"), ["k"], ["v"], lambda p: p.head(1), "k int, v int")
    assert [tuple(r) for r in g.collect()] == [(1, 1)]


def test_models(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "hello world"), (4, "other text")], "id int, t string")
    got = {r.id: r.embedding for r in models.embed(df, "t", models.HashEncoder).collect()}
    assert got[2] is None and got[1] == got[3] and np.dot(got[1], got[3]) == pytest.approx(1) and np.dot(got[1], got[4]) < 0.9
    back = models.map_distinct(df.where("t is not null"), "t", lambda d: d.selectExpr("t", "length(t) as n"))
    assert sorted((r.id, r.n) for r in back.collect()) == [(1, 11), (3, 11), (4, 10)]
    assert models.map_batches(df, lambda b: None, "id int").count() == 0


def plain_speech(probs, threshold, total, window, least_speech, least_silence, pad):
    """The rule frame by frame."""
    spans, start, quiet = [], None, None
    for k, p in enumerate(probs):
        at = k * window
        if p >= threshold:
            quiet = None
            start = at if start is None else start
        elif start is not None and p < threshold - 0.15:
            quiet = at if quiet is None else quiet
            if at - quiet >= least_silence:
                spans += [[start, quiet]] * (quiet - start > least_speech)
                start = quiet = None
    if start is not None and total - start > least_speech:
        spans.append([start, total])
    out = [list(s) for s in spans]
    for k in range(len(spans)):
        if k == 0:
            out[k][0] = int(max(0, spans[k][0] - pad))
        if k == len(spans) - 1:
            out[k][1] = int(min(total, spans[k][1] + pad))
        elif (gap := spans[k + 1][0] - spans[k][1]) < 2 * pad:
            out[k][1] += gap // 2
            out[k + 1][0] = max(0, spans[k + 1][0] - gap // 2)
        else:
            out[k][1] += int(pad)
    return [tuple(s) for s in out]


def test_speech_spans(spark):
    import random

    r = random.Random(2)
    rows = [[0.9, 0.9, 0.2, 0.4, 0.2, 0.4, 0.2, 0.9, 0.9], [], [0.1] * 5, [0.9] * 5]
    rows += [[r.choice([0.0, 0.2, 0.36, 0.45, 0.5, 0.9]) for _ in range(r.randint(1, 60))] for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, p array<double>")
    for window, speech, silence, pad in ((1, 1, 4, 0), (10, 10, 20, 4), (10, 0, 0, 25), (1536, 4000, 1600, 480)):
        got = {x.id: [tuple(s) for s in x.s] for x in df.select("id", S.speech_spans(df.p, 0.5, None, window, speech, silence, pad).alias("s")).collect()}
        assert got == {k: plain_speech(p, 0.5, len(p) * window, window, speech, silence, pad) for k, p in enumerate(rows)}
    assert len([s for s in plain_speech(rows[0], 0.5, 9, 1, 1, 4, 0)]) == 2


def test_monotone_pairs_against_all(spark):
    import itertools

    r = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 3), (3, 3), (4, 2), (4, 5)):
        for _ in range(10):
            sims = r.random((n, m)).round(2) + 0.01
            best = max(sum(sims[i, j] for i, j in zip(a, b)) for k in range(1, min(n, m) + 1) for a in itertools.combinations(range(n), k) for b in itertools.combinations(range(m), k))
            pairs = S.monotone_pairs(sims)
            assert abs(sum(sims[p] for p in pairs) - best) < 1e-9
            inner = S.monotone_pairs(sims, stop_at_edge=True)
            assert inner == [p for p in pairs if p[0] and p[1]]


def test_null_ids_keep_their_places(spark):
    from weirline.functions import nested
    from weirline.operators import sampling

    rows = [(5, 2, "a", [1, 2]), (None, 3, "a", [3]), (1, 4, None, [4, 5, 6]), (2**60, 1, "a", [7]), (7, 6, "a", None), (3, 5, None, [])]
    df = spark.createDataFrame(rows, "id long, size int, g string, v array<int>").repartition(3)
    assert {(r.id, r.pos) for r in sampling.positions(df, "id").collect()} == {(1, 0), (3, 1), (5, 2), (7, 3), (2**60, 4), (None, 5)}
    found = {(r.id, r.at) for r in sampling.offsets(df, "size", "id", "g", "at").collect()}
    assert found == {(1, 0), (3, 4), (5, 0), (7, 2), (2**60, 8), (None, 9)}
    packs = {(r.g, r.pack): (r["items"], r.rows) for r in nested.pack(df, "v", "id", 3, "g").collect()}
    assert packs == {("a", 0): ([1, 2, 7], [5, 5, 2**60]), ("a", 1): ([3], [None]), (None, 0): ([4, 5, 6], [1, 1, 1])}
    assert sampling.positions(df.limit(0), "id").count() == 0
    wide = sampling.ranges(spark.range(10_000).union(spark.range(1).selectExpr("1L << 60 as id")), "id", "b", 16)
    assert wide.groupBy("b").count().agg({"count": "max"}).first()[0] < 1500


def test_group_apply(spark):
    import pyarrow as pa

    from weirline.operators import models

    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4), (None, 5)], "k string, v long").repartition(1)
    count = lambda t: pa.table({"k": t.column("k").slice(0, 1), "n": [t.num_rows]})
    got = {(r.k, r.n) for r in models.apply_over_groups(df, ["k", None], count, "k string, n long").collect()}
    assert got == {("a", 2), ("b", 1), (None, 2)}
    assert [r.n for r in models.apply_over_groups(df, [None], count, "k string, n long").collect()] == [5]


def test_spaces_inside_numbers():
    from weirline.functions import spoken

    assert spoken.number_words("1 000 000 people") == "one million people"
    assert (spoken.number_words("1 2", joined=True), spoken.number_words("1 2")) == ("twelve", "one two")
