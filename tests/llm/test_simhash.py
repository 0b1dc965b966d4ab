import re

import numpy as np
import pyarrow as pa
import xxhash

from weirline.llm import simhash

SCHEMA = "source string, doc_id long, text string, key string, fp string"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Smallest id reachable, all pairs."""
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if bin(fps[a] ^ fps[b]).count("1") <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_against_all_pairs(spark):
    base = " ".join(f"w{i}" for i in range(60))
    texts = [base, base.upper(), base + " x", "y " + base, None, "", " \t\n", "one", "One two", "one two three four", "straße 😀 éa", base.replace("w30", "z"), base.replace("w3", "q"), " ".join(["same"] * 5000), base, "one"]
    rows = [("s", i, t, "k", "f") for i, t in enumerate(texts)]
    got = {r.id: (r.fp & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: plain(t) for i, t in enumerate(texts)}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute(fps)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def keys_of(fps, hot):
    """Rows of the index as the task sees them, in small batches."""
    rows = []
    for rep, f in enumerate(fps):
        for i, (low, width, radius) in enumerate(simhash.SEGMENTS):
            v = f >> low & (1 << width) - 1
            rows.append((i << 32 | v, f, rep, True))
            rows += [(i << 32 | v | 1 << b, f, rep, False) for b in range(width) if radius and not v >> b & 1]
    rows.sort(key=lambda r: (r[0], not r[3]))
    key, fp, rep, exact = (np.array(x, kind) for x, kind in zip(zip(*rows), (np.int64, np.uint64, np.int64, bool)))
    for at in range(0, len(rows), hot):
        s = slice(at, at + hot)
        yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(fp[s].view(np.int64)), pa.array(rep[s]), pa.array(exact[s])], names=["key", "fp", "rep", "exact"])


def test_dense_ball_and_hot_bucket(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = sorted({centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))}) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 30)})
    want = brute(dict(enumerate(fps)))

    def labels(edges):
        f = simhash.Forest()
        for a, b in edges:
            f.join(a, b)
        return {i: f.root(i) for i in range(len(fps))}

    def links(n):
        out = [r for b in simhash._links(keys_of(fps, n)) for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        return [x for x in out if x[1] is not None], {a for a, b in out if b is None}

    edges, hot = links(37)
    assert not hot and labels(edges) == want and len(edges) < len(fps)
    monkeypatch.setattr(simhash, "HOT_BUCKET", 20)
    edges, hot = links(64)
    assert hot
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    met = simhash.hot_links(spark.createDataFrame([(signed[i], i) for i in hot], "fp long, rep long"))
    assert labels(edges + [(r.u, r.v) for r in met.collect()]) == want


def test_every_layout_finds_every_link(spark, monkeypatch):
    from weirline.llm.common import Scratch

    rng = np.random.default_rng(6)
    centre = int(rng.integers(1 << 62)) | 1 << 63
    fps = sorted({centre ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))}) for _ in range(90)} | {int(x) for x in rng.integers(0, 1 << 62, 20)})
    want = brute(dict(enumerate(fps)))
    reps = spark.createDataFrame(list(zip(np.array(fps, np.uint64).view(np.int64).tolist(), range(len(fps)))), "fp long, rep long")
    sizes = set()
    for share, segments in simhash.layouts():
        monkeypatch.setattr(simhash, "MEMBERS", len(fps) * share * 1.01)
        assert simhash.layout(len(fps)) == segments
        sizes.add(len(segments))
        forest = simhash.Forest()
        for e in simhash.linked(reps, Scratch(spark, "layouts")).collect():
            forest.join(e.u, e.v)
        assert {i: forest.root(i) for i in range(len(fps))} == want
    assert sizes == {3, 35, 70} and len(simhash.layout(1 << 60)) == 70


def test_layouts_leave_no_pair_out():
    r = np.random.default_rng(7)
    for _, segments in simhash.layouts():
        assert all(len({b for low, w in parts for b in range(low, low + w)}) == sum(w for _, w in parts) <= 32 for parts, _ in segments)
        for _ in range(3000):
            bits = set(r.choice(64, 4, replace=False).tolist())
            assert any(sum(low <= b < low + w for b in bits for low, w in parts) <= radius for parts, radius in segments)


def test_components_of_paths_and_stars(spark):
    from weirline.llm.common import Scratch, connected_components

    path = [(i, i + 1) for i in range(100, 160)]
    star = [(999, i) for i in range(200, 260)]
    zig = [(300 + i * 37 % 61, 300 + (i + 1) * 37 % 61) for i in range(60)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path + star + zig + [(5, 5)], "u long, v long"), Scratch(spark, "t")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[999] == 200 and {got[300 + i] for i in range(61)} == {300} and 5 not in got
