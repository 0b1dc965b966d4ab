import random
import re
from collections import Counter

import numpy as np

from weirline.llm import decontaminate as dc


def plain_words(t):
    return re.sub("[!-/:-@\\[-`{-~]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")).split() if t else []


def grams(w):
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute(text, items):
    w, out = plain_words(text), {}
    for item, t in items:
        g = plain_words(t)
        if not w or not g:
            continue
        size, want = min(len(g), len(w)), grams(g)
        for s in range(len(w) - size + 1):
            a = grams(w[s : s + size])
            least = sum((a & want).values())
            sim = least / (sum(a.values()) + sum(want.values()) - least)
            if sim >= 0.8 and (-sim, s) < (-out.get(item, (0, 0))[0], out.get(item, (0, 0))[1]):
                out[item] = (sim, s)
    return out


def cases():
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(40)] + ["The", "of", "é"]
    text = lambda n: " ".join(r.choices(vocab, k=n))
    items = [(i, text(r.randint(1, 60))) for i in range(40)] + [(40, "same " * 30), (41, "..."), (42, None), (43, "x y")]
    docs = [None, "", "...", "x y", "x", "X, y!", "same " * 400, text(3000)]
    for i, t in items[:41]:
        w = t.split()
        for cut in (0, 1, 2, 6):
            v = list(w)
            for _ in range(cut):
                v[r.randrange(len(v))] = "zz"
            docs.append(text(r.randint(0, 50)) + " " + " ".join(v) + " " + text(r.randint(0, 50)))
        docs.append(" ".join(w[1:]))
        docs.append(" ".join(w[:10] + ["new"] + w[10:]).upper())
        docs.append("\n".join(w) + ".\n" + items[(i + 1) % 40][1])
    return docs, items


def test_equals_all_windows():
    docs, items = cases()
    index = dc.Index([(i, t) for i, t in items if t])
    n = 0
    for d in docs:
        want = brute(d, items)
        got = index.search(d)
        assert {k: (round(s, 9), at) for k, (s, at) in got.items()} == {k: (round(s, 9), at) for k, (s, at) in want.items()}, d
        n += len(want)
    assert n > 100


def test_tables_and_passes(spark):
    docs, items = cases()
    df = spark.createDataFrame([("i", k % 50, t, "s") for k, t in enumerate(docs)], "item_id string, doc_id long, text string, similarity string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item_id) for r in dc.matches(df, bench).collect()}
    want = {(k % 50, i) for k, t in enumerate(docs) for i in brute(t, items)}
    assert got == want
    left = dc.clean(df, bench)
    assert left.columns == df.columns and sorted(str(r.text) for r in left.collect()) == sorted(str(t) for t in docs if not brute(t, items))
    assert len(list(dc.passes(bench, pass_bytes=400))) > 2
    assert dc.matches(df, bench.limit(0)).count() == 0 and dc.clean(df, bench.limit(0)).count() == len(docs) and dc.matches(df.limit(0), bench).count() == 0


def test_several_passes_and_share_of_the_index(spark):
    docs, items = cases()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, more = (sorted((r.id, r.item_id, round(r.similarity, 9), r.start) for r in dc.matches(df, bench, pass_bytes=n).collect()) for n in (1 << 20, 600))
    assert one == more and sorted(r.doc_id for r in dc.clean(df, bench, pass_bytes=600).collect()) == sorted(set(range(len(docs))) - {r[0] for r in one})
    rng = np.random.default_rng(1)
    g = dc.Group(200, list(range(300)), [rng.integers(0, 1 << 63, 196).astype(np.uint64) for _ in range(300)]).build()
    prints = rng.integers(0, 1 << 63, (2000, 2)).astype(np.uint64)
    looked = sum(int((np.searchsorted(near, v, "right") - np.searchsorted(near, v)).sum()) for v, (near, _) in zip(prints.view(np.uint16).reshape(-1, 8).T, g.table))
    assert looked < 0.1 * 300 * 2000 and len(g.candidates(prints)[0]) == 0


def test_share_found_at_the_similarity():
    """Windows at 0.8 to 0.82 of items of 30 to 300 shingles: the radius finds over 99 in 100."""
    rng = np.random.default_rng(2)
    found = n = 0
    for size in (30, 60, 120, 300):
        base = [rng.integers(0, 1 << 63, size).astype(np.uint64) for _ in range(250)]
        g = dc.Group(size, list(range(250)), base).build()
        cut = int(size * 2 / 18)  # shingles replaced: (size - cut) / (size + cut) is 0.8 or little more
        for k, h in enumerate(base):
            v = h.copy()
            v[rng.choice(size, cut, replace=False)] = rng.integers(0, 1 << 63, cut).astype(np.uint64)
            _, i = g.candidates(dc.window_prints(v, np.array([0]), size))
            found, n = found + (k in i), n + 1
    assert found >= 0.99 * n
