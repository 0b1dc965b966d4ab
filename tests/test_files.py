import lzma
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.sources import files as S


def test_lines_offsets_shards(spark, tmp_path):
    text = ["", "ä line", "third", "x" * 50, "last"]
    (tmp_path / "a.txt").write_bytes("\n".join(text).encode() + b"\n")
    (tmp_path / "b.txt").write_bytes(b"bad \xff byte\nok\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")  # many splits of one file
    try:
        lines = S.numbered_lines(spark, f"file://{tmp_path}/a.txt")
        got = {r.line_no: (r.offset, r.text) for r in lines.collect()}
        assert [got[k][1] for k in range(5)] == text
        at = np.cumsum([0] + [len(x.encode()) + 1 for x in text])
        assert [got[k][0] for k in range(5)] == at[:-1].tolist()
        assert sorted(r.line_no for r in S.skipped(lines, 3).collect()) == [3, 4]
        assert [r.text for r in S.byte_range(lines, 1, int(at[3])).orderBy("line_no").collect()] == ["ä line", "third"]
        chunks = {r.chunk: (r.start, r.first_line) for r in S.chunk_offsets(lines, 2).collect()}
        assert chunks[0] == (0, 0) and chunks[1][0] in at
        assert [r.shard for r in S.text_shards(lines, 2, "robin").orderBy("line_no").collect()] == [0, 1, 0, 1, 0]
        assert [r.shard for r in S.text_shards(lines, 2).orderBy("line_no").collect()] == [0, 0, 0, 1, 1]
        bad = S.numbered_lines(spark, f"file://{tmp_path}/b.txt").orderBy("line_no").collect()
        assert [r.text for r in bad] == ["bad � byte", "ok"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert S.sorted_shards(spark.createDataFrame([(3,), (1,), (3,)], "k int"), "k", 2, unique=True).count() == 2


def test_discovery_corpora_and_columns(spark, tmp_path):
    for name, body in (("c.eng.txt", "a\nb\n"), ("c.fra.txt", "x\ny\n"), ("d.eng_Latn", "q\n"), ("m.tsv", "1.5\ts 1\tt 1\n0.5\ts 2\tt\t2\n"), ("h.tsv", "one\ttwo\n1\t2\n3\t4\n"), ("p.lst", " bad \n\nbad\nworse\n")):
        (tmp_path / name).write_text(body)
    base = f"file://{tmp_path}"
    files = S.list_files(spark, base)
    assert files.count() == 6 and S.list_files(spark, base, suffix=".tsv").count() == 2
    assert {r.lang for r in S.languages_of(files).collect()} >= {"eng", "fra", "eng_Latn"}
    assert [(r.src[-9:], r.tgt[-9:]) for r in S.corpora_of(files, "eng", "fra").collect()] == [("c.eng.txt", "c.fra.txt")]
    both = S.read_corpus(spark, S.Corpus(src=f"{base}/c.eng.txt", tgt=f"{base}/c.fra.txt", metadata=f"{base}/c.eng.txt"))
    assert sorted((r.src, r.tgt, r.metadata) for r in both.collect()) == [("a", "x", "a"), ("b", "y", "b")]
    mined = S.read_corpus(spark, S.Corpus(tsv=f"{base}/m.tsv")).orderBy("line_no").collect()
    assert [(r.score, r.src, r.tgt) for r in mined] == [(1.5, "s 1", "t 1"), (0.5, "s 2", "t\t2")]
    for bad in ({}, {"src": "a", "tsv": "b"}, {"tsv": "b", "tgt": "c"}, {"src": "a", "metadata": "m"}):
        with pytest.raises(ValueError):
            S.Corpus(**bad)
    assert [r.value for r in S.read_column(spark, f"{base}/h.tsv:two").orderBy("line_no").collect()] == ["2", "4"]
    assert [r.value for r in S.read_column(spark, f"{base}/h.tsv:0").orderBy("line_no").collect()] == ["one", "1", "3"]
    assert S.read_positional(spark, f"{base}/h.tsv", ["a", "b"]).columns == ["a", "b"]
    assert sorted(r.phrase for r in S.load_phrases(spark, f"{base}/p.lst").collect()) == ["bad", "worse"]
    assert {r.pieces for r in S.split_sizes(files, 10).collect()} == {1, 2, 3}


def test_xz_matrices_and_halves(spark, tmp_path):
    (tmp_path / "t.xz").write_bytes(lzma.compress("eins\nzwei\n".encode()))
    assert [(r.line_no, r.text) for r in S.xz_lines(spark, f"file://{tmp_path}/t.xz").orderBy("line_no").collect()] == [(0, "eins"), (1, "zwei")]
    m = np.arange(12, dtype=np.float16).reshape(4, 3)
    np.save(tmp_path / "a.npy", m)
    (tmp_path / "b.bin").write_bytes(m.astype("<f4").tobytes())
    a, b = S.read_matrix(spark, f"file://{tmp_path}/a.npy"), S.read_matrix(spark, f"file://{tmp_path}/b.bin", dim=3)
    assert [r.embedding for r in a.orderBy("row").collect()] == [r.embedding for r in b.orderBy("row").collect()] == m.tolist()
    assert [r.row for r in S.concatenated(a.unionByName(b)).orderBy("row").collect()] == list(range(8))
    df = a.select("embedding", S.half_bits(F.col("embedding")).alias("h"))
    assert all(r.embedding == r.back for r in df.withColumn("back", S.from_half_bits(F.col("h"))).collect())


def test_references_names_and_provenance(spark, tmp_path):
    class Kind(Enum):
        A = "a"

    @dataclass
    class Conf:
        k: Kind
        n: tuple

    df = spark.createDataFrame([("x.wav:3:40",), ("x.wav:3:40:16000",), ("dir/y.wav",), ("1.5",), ("some text",)], "c string")
    got = df.select(S.media_fields(F.col("c")).alias("m"), S.typed_cell(F.col("c"))["kind"].alias("k")).collect()
    assert [tuple(r.m) for r in got[:3]] == [("x.wav", 3, 40, None), ("x.wav", 3, 40, 16000), ("dir/y.wav", None, None, None)]
    assert [r.k for r in got] == ["audio", "audio", "audio", "number", "text"]
    assert S.output_name("in/a.txt.gz", "out/", ".dedup") == "out/a.dedup.txt" and S.output_name("a", "o", "_x") == "o/a_x"
    out = S.with_provenance(S.with_provenance(df, {"conf": Conf(Kind.A, (1, 2))}, 1.0), {"step": 2}, 2.0)
    out.write.parquet(f"file://{tmp_path}/p")
    meta = spark.read.parquet(f"file://{tmp_path}/p").schema[0].metadata["provenance"]
    assert meta == {"step": 2, "saved_at": 2.0, "previous": {"conf": {"k": "a", "n": [1, 2]}, "saved_at": 1.0}}
    lines = spark.createDataFrame([(1, 0, "b"), (0, 1, "a2"), (0, 0, "a1"), (1, 1, "c")], "shard int, line_no int, text string")
    S.write_ordered(lines, f"file://{tmp_path}/o", ["shard", "line_no"], files=2)
    read = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert read == "a1\na2\nb\nc\n"
    S.write_shuffled_shards(spark.range(100), f"file://{tmp_path}/s", 4, "id", 3)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_shard_plans(spark):
    files = spark.createDataFrame([("a", 10), ("b", 30), ("c", 5), ("d", 20)], "path string, length long")
    plan = lambda **k: {r.path: r.shard for r in S.plan_shards(files, 40, **k).collect()}
    assert plan() == {"a": 0, "b": 0, "c": 1, "d": 1} and plan(order="increasing") == {"c": 0, "a": 0, "d": 0, "b": 0} and plan(order="decreasing") == {"b": 0, "d": 0, "a": 1, "c": 1}
    assert plan(order="random", seed=1) == plan(order="random", seed=1)


def test_audio_header(spark, tmp_path):
    import wave

    with wave.open(f"{tmp_path}/a.wav", "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes(b"\0" * 4 * 8000)
    (tmp_path / "b.wav").write_bytes(b"no header")
    got = spark.read.format("binaryFile").load(f"file://{tmp_path}").orderBy("path").select(S.wav_fields(F.col("content")).alias("w")).collect()
    assert tuple(got[0].w) == (2, 16000, 0.5) and got[1].w is None
