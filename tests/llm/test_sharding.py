import zlib
from collections import defaultdict

import numpy as np

from weirline.llm import sharding


def test_pack_is_even_in_all_dimensions():
    rng = np.random.default_rng(3)
    n = 3000
    load = np.stack([rng.lognormal(7, 1, n), rng.lognormal(5, 1, n), np.ones(n)], 1).round()
    at = sharding.pack(load, 8)
    for d in range(3):
        sums = np.bincount(at, load[:, d], 8)
        assert np.ptp(sums) < (0.001 if d == 0 else 0.35) * sums.mean(), d
    assert len(sharding.pack(np.zeros((0, 3)), 8)) == 0


def test_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["a", "bé", "cc\n"], rng.integers(1, 200)))) for i in range(900)]
    rows += [(1000 + i, "the hot text " * 20) for i in range(450)] + [(2000 + i, None) for i in range(3)] + [(2003, ""), (7, rows[7][1]), (None, "x")]
    df = spark.createDataFrame([(t, "slot", i, 1) for i, t in rows], "text string, slot string, doc_id long, shard int")
    got = sharding.shard(df).collect()
    assert len(got) == len(rows)
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), -1 if i is None else i) for i, t in rows)
    assert sorted((r.size, r.text_crc32, -1 if r.id is None else r.id) for r in got) == want
    slots, sizes, homes = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
        homes[r.text_crc32].add(r.shard)
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    hot = zlib.crc32(("the hot text " * 20).encode())
    assert len(homes.pop(hot)) > 1 and all(len(h) == 1 for h in homes.values())


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
