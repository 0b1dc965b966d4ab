import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.operators import batching as B
from weirline.operators import intervals
from weirline.operators import sequences as S


def plain_bounds(lengths, most):
    """Cuts by going on place by place; the last batch only where its longest row fits."""
    cuts, at = [0], 0
    for i, n in enumerate(lengths):
        if n * (i - at) > most:
            at = i - 1
            cuts.append(at)
    if lengths and lengths[-1] <= most:
        cuts.append(len(lengths))
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


def test_token_bounds_against_a_plain_loop(spark):
    r = random.Random(3)
    rows = [(i, sorted(r.choice((0, 1, 2, 5, 9, 30, 200)) for _ in range(r.randrange(25)))) for i in range(120)] + [(120, []), (121, [50]), (122, [1, 50, 60]), (123, [0, 0, 0])]
    df = spark.createDataFrame(rows, "id int, n array<int>")
    got = {x.id: [tuple(b) for b in x.b] for x in df.select("id", B.token_bounds(F.col("n"), 40).alias("b")).collect()}
    assert got == {i: plain_bounds(n, 40) for i, n in rows}
    whole = df.select("n", B.token_bounds(F.col("n"), 40, keep_long=True).alias("b")).collect()
    assert all([k for a, b in x.b for k in range(a, b)] == list(range(len(x.n))) for x in whole)


def test_lengths_of_kinds(spark):
    df = spark.createDataFrame([([1, 2], "äb", bytearray(b"abc"), {"k": 1}, 5), (None, None, None, None, 5), ([], "", bytearray(), {}, 5)], "a array<int>, s string, b binary, m map<string,int>, i int")
    got = df.select(*(B.element_length(df, c) for c in "asbm")).collect()
    assert [tuple(x) for x in got] == [(2, 2, 3, 1), (0, 0, 0, 0), (0, 0, 0, 0)]
    with pytest.raises(TypeError):
        B.element_length(df, "i")


def test_epochs_are_whole_and_seeded(spark):
    r = random.Random(5)
    rows = [(i, i // 9, "x" * r.choice((0, 1, 7, 30, 31, 32, 90))) for i in range(400)] + [(400, None, "lone"), (401, 44, None)]
    df = spark.createDataFrame(rows, "id int, part int, text string")
    make = lambda **k: B.epoch(df, "part", "id", together=4, **k).collect()
    one = make(max_tokens=200, length="text", ranks=3, seed=1, keep_long=True)
    assert sorted(x.id for x in one) == list(range(402)) and len(one[0].asDict()) == 7
    parts = {k: {x.part for x in one if x["rank"] == k} for k in range(3)}
    assert not parts[0] & parts[1] and not parts[1] & parts[2] and max(map(len, parts.values())) - min(map(len, parts.values())) <= 1
    batches = {}
    for x in one:
        batches.setdefault((x["rank"], x.step, x["batch"]), []).append((x["at"], len(x.text or "")))
    assert all(sorted(a for a, _ in b) == list(range(len(b))) for b in batches.values())
    assert all((max(n for _, n in b)) * (len(b) - 1) <= 200 for b in batches.values() if len(b) > 1)
    spread = [max(n for _, n in b) - min(n for _, n in b) for b in batches.values()]
    assert np.mean(spread) < 15
    again, other = make(max_tokens=200, length="text", ranks=3, seed=1, keep_long=True), make(max_tokens=200, length="text", ranks=3, seed=2, keep_long=True)
    key = lambda out: sorted((x.id, x["rank"], x.step, x["batch"], x["at"]) for x in out)
    assert key(one) == key(again) != key(other) and {(x.id, x["rank"]) for x in one} == {(x.id, x["rank"]) for x in other}
    own = make(max_tokens=200, length="text", ranks=3, rank=1, seed=1, keep_long=True)
    assert key(own) == [x for x in key(one) if x[1] == 1]


def test_epochs_of_fixed_batches(spark):
    df = spark.createDataFrame([(i, i // 10, "y" * (i % 13)) for i in range(205)], "id int, part int, text string")
    out = B.epoch(df, "part", "id", batch_size=8, together=100, seed=3).collect()
    sizes = sorted(sum(1 for x in out if x["batch"] == b) for b in {x["batch"] for x in out})
    assert sizes == [5] + [8] * 25 and [x.id for x in sorted(out, key=lambda x: (x["batch"], x["at"]))] != list(range(205))
    assert len(B.epoch(df, "part", "id", batch_size=8, together=100, seed=3, min_rows=6).collect()) == 200
    assert B.epoch(df.limit(0), "part", "id", max_tokens=9, length="text").count() == 0
    for wrong in ({}, {"batch_size": 1, "max_tokens": 1}, {"max_tokens": 1}):
        with pytest.raises(ValueError):
            B.epoch(df, "part", "id", **wrong)
    with pytest.raises(ValueError):
        B.epoch(df.withColumnRenamed("id", "at"), "part", "at", batch_size=1)


def test_runs_are_those_of_plain_loops(spark):
    r = random.Random(8)
    rows = [(g, i, r.choice((None, 0.0, 1.0, 3.0, 9.0)), r.random() < 0.2, r.choice((True, False, None))) for g in range(12) for i in range(r.randrange(1, 30))]
    df = spark.createDataFrame(rows, "g int, i int, d double, fresh boolean, may boolean").repartition(3)
    ends = B.capped_ends("d", lambda x: x["fresh"], lambda x: x["may"], 8.0)
    got = {(x.g, x.i): x.segment for x in B.numbered_runs(df, ["g"], ["i"], ends, "segment").collect()}
    want = {}
    for g in range(12):
        own = [x for x in rows if x[0] == g]
        for x, k in zip(own, S.capped_segments([x[2] or 0.0 for x in own], [x[3] for x in own], [bool(x[4]) for x in own], 8.0)):
            want[g, x[1]] = k
    assert got == want
    sized = spark.createDataFrame([(x[0], x[1], int(3 * (x[2] or 0))) for x in rows], "g int, i int, n int")
    got = {(x.g, x.i): x["batch"] for x in B.numbered_runs(sized, ["g"], ["n", "i"], B.padded_ends("n", 40), "batch").collect()}
    for g in range(12):
        own = [(x[1], int(3 * (x[2] or 0))) for x in rows if x[0] == g]
        assert {i: got[g, i] for i, _ in own} == dict(zip((i for i, _ in own), S.padded_batches([n for _, n in own], 40)))


def test_suppression_of_groups_is_that_of_one_loop(spark):
    r = random.Random(9)
    rows = [("hot" if r.random() < 0.6 else r.choice("ab"), float(s), float(s + r.choice((0, 1, 4, 15))), r.random(), i) for i, s in enumerate(r.sample(range(3000), 900))]
    df = spark.createDataFrame(rows, "key string, start double, end double, score double, id int").repartition(4)
    for most in (0.0, 0.1, 0.5):
        want = set()
        for k in {x[0] for x in rows}:
            own = [x for x in rows if x[0] == k]
            want |= {own[i][4] for i in S.suppress([x[1:4] for x in own], most)}
        assert {x.id for x in S.suppress_groups(df, "key", most=most).collect()} == want
    odd = [("a", None, 5.0, 1.0, 1), ("a", 0.0, None, 1.0, 2), ("a", 0.0, 5.0, None, 3), (None, 0.0, 5.0, 1.0, 4), (None, 1.0, 5.0, 2.0, 5), ("a", 0.0, 5.0, 1.0, 6), ("a", 0.0, 5.0, 1.0, 6)]
    got = S.suppress_groups(spark.createDataFrame(odd, df.schema), "key")
    assert got.columns == df.columns and sorted(x.id for x in got.collect()) == [1, 2, 3, 5, 6]
    assert S.suppress_groups(df.limit(0), "key").count() == 0


def plain_divide(p, longest, shortest, threshold):
    """The rule by recursion over lists."""

    def trim(at, part):
        on = [i for i, x in enumerate(part) if x >= threshold]
        return (at + on[0], part[on[0] : on[-1] + 1]) if on else (at, [])

    def go(at, part):
        if len(part) < longest:
            return [(at, at + len(part))]
        sides = []
        for k in sorted(range(len(part)), key=lambda i: (part[i], i)):
            sides = [trim(at, part[:k]), trim(at + k + 1, part[k + 1 :])]
            if min(len(q) for _, q in sides) > shortest:
                break
        return [x for a, q in sides if len(q) > shortest for x in go(a, q)]

    return sorted(go(*trim(0, list(p))))


def test_divide_against_recursion():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 40, 200):
        for _ in range(20):
            p = r.random(n).round(1)
            assert S.divide(p, 12, 2, 0.3) == plain_divide(p.tolist(), 12, 2, 0.3)


def test_words_of_frames_against_plain_loops(spark):
    r = random.Random(4)
    rows = [(k, i, tok, None if tok is None else tok, r.choice((None, 0.5, 1.0))) for k in range(25) for i, tok in enumerate(r.choices(["a", "b", "|", None], k=r.randrange(1, 14)))]
    df = spark.createDataFrame(rows, "k int, t int, tok string, l string, sc double").repartition(3)
    seg = intervals.frame_segments(df, "k", "t", "tok", "l", "sc")
    got, words = {}, {}
    for x in seg.orderBy("key", "segment").collect():
        got.setdefault(x.key, []).append((x.label, x.start, x.end, x.score))
    for x in intervals.segment_words(seg, "|", 2.0).orderBy("key", "word").collect():
        words.setdefault(x.key, []).append((x.text, x.start, x.end))
    for k in range(25):
        want, own = [], [x for x in rows if x[0] == k]
        for _, i, tok, label, sc in own:
            if want and want[-1][0] == tok:
                want[-1][2], want[-1][3] = i + 1, want[-1][3] + [sc]
            else:
                want.append([tok, i, i + 1, [sc]])
        mean = lambda v: sum(x for x in v if x is not None) / n if (n := sum(x is not None for x in v)) else None
        assert got[k] == [(a, b, c, mean(v)) for a, b, c, v in want]
        said = [["", -1.0, -1.0]]
        for a, b, c, _ in want:
            if a == "|":
                said.append(["", -1.0, -1.0])
            else:
                said[-1] = [said[-1][0] + (a or ""), said[-1][1] if said[-1][1] >= 0 else b / 2, c / 2]
        assert words[k] == [tuple(x) for x in said]
    assert intervals.segment_words(intervals.frame_segments(df.limit(0), "k", "t", "tok", "l", "sc"), "|").count() == 0
