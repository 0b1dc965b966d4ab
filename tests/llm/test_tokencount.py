import numpy as np
import pytest

from weirline.llm import tokencount as tc

TEXTS = [None, "", "one", "hello world " * 3000, "é😀", "", "", "a\n\nb", "x " * 10, "<|endoftext|>"]


def plain(t):
    return len(tc.encoder(tc.VOCAB)[0].encode_ordinary(t)) if t else 0


@pytest.mark.parametrize("block_bytes", [2, 16, 4096, 1 << 20])
def test_counts(spark, block_bytes, monkeypatch):
    monkeypatch.setattr(tc, "SUPER", 7)
    texts = TEXTS if block_bytes > 16 else [t and t[:100] for t in TEXTS]
    rows = [(i % 9, t, "f") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, file string").repartition(3)
    got = sorted((r.id, r.n_tokens) for r in tc.count_tokens(df, block_bytes=block_bytes).collect())
    assert got == sorted((i, plain(t)) for i, t, _ in rows)


def test_long_runs(spark, monkeypatch):
    enc, ranks = tc.encoder(tc.VOCAB)
    r = np.random.default_rng(3)
    bits = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "a", "Zé", "12", "'s", "'", "...", "日本", "😀", " word", "\r\n "]
    texts = ["".join(r.choice(bits, r.integers(1, 400), p=None)) + str(r.choice(bits)) * int(r.integers(0, 300)) + "".join(r.choice(bits, 20)) for _ in range(150)]
    monkeypatch.setattr(tc, "LONG", 40)
    for t in texts:
        assert tc.token_ids(t, enc, ranks) == enc.encode_ordinary(t), t
    monkeypatch.undo()
    long = ["a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "a" * 300_000, "ab1" * 100_000, " \t" * 500_000 + "x"]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.id: r.n_tokens for r in tc.count_tokens(df).collect()}
    assert len(got) == 5 and all(n > 0 for n in got.values())
    for t in long:
        assert b"".join(enc.decode_single_token_bytes(i) for i in tc.token_ids(t, enc, ranks)) == t.encode()


def test_empty(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_flat_files_with_open_end(spark, tmp_path):
    rng = np.random.default_rng(0)
    want = set()
    for k in range(3):
        ids = np.where(rng.random(5000 + k) < 0.01, tc.EOD, rng.integers(0, 50000, 5000 + k)).astype("<u2")
        (tmp_path / f"{k}.bin").write_bytes(ids.tobytes())
        cuts = np.flatnonzero(ids == tc.EOD)
        n = np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1
        want |= {(f"{k}.bin", i, int(x)) for i, x in enumerate(n) if i < len(cuts) or x}
    got = tc.stitch(tc.scan_blocks(tc.read_flat(spark, f"file://{tmp_path}", 512))).collect()
    assert {(r.file.rsplit("/", 1)[-1], r.ordinal, r.n_tokens) for r in got} == want and len(got) == len(want)
