import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from weirline.sources import matrix, single


def rows(spark, n, dim):
    return spark.range(n).select("id", F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: (F.col("id") * 10 + k).cast("float")).alias("embedding")).repartition(5)


def expected(n, dim):
    return (np.arange(n)[:, None] * 10 + np.arange(dim)).astype("<f4")


def test_one_npy_of_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/m.npy"
    assert single.write_matrix(rows(spark, 1000, 7), path, ["id"], parts=6) == 1000
    assert np.array_equal(np.load(path), expected(1000, 7)) and os.listdir(tmp_path) == ["m.npy"]
    assert single.write_matrix(rows(spark, 1000, 7), path, ["id"], dtype="<f2", parts=3) == 1000  # replaces the old one
    assert np.load(path).dtype == np.float16
    assert single.write_matrix(rows(spark, 10, 7).limit(0), f"{tmp_path}/none.npy", ["id"]) == 0
    assert np.load(f"{tmp_path}/none.npy").shape == (0, 0)


def test_failed_writes_leave_nothing(spark, tmp_path):
    odd = rows(spark, 50, 3).withColumn("embedding", F.when(F.col("id") == 31, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="not all vectors"):
        single.write_matrix(odd, f"{tmp_path}/m.npy", ["id"], parts=4)

    def encode(b, places):
        if places[0] and 31 in b.column("id").to_pylist():
            raise OSError("disk full")
        return [b"x" * b.num_rows]

    placed = single.in_parts(rows(spark, 50, 3).select("id"), ["id"], 4)
    with pytest.raises(Exception, match="disk full"):
        single.write_single(placed, f"{tmp_path}/x", encode, lambda n: b"head")
    assert os.listdir(tmp_path) == []
    with pytest.raises(ValueError):
        single.local("s3://bucket/x")


def test_ranges_of_matrix_files(spark, tmp_path):
    np.save(tmp_path / "a.npy", expected(1000, 7))
    expected(500, 7).astype("<f2").tofile(tmp_path / "b.bin")
    with open(tmp_path / "b.hdr", "wb") as f:
        f.write(single.npy_header(500, 7, "<f2"))
    (tmp_path / "bare").mkdir()
    expected(20, 4).astype("<f8").tofile(tmp_path / "bare" / "c.bin")
    df = matrix.read_matrix(spark, f"file://{tmp_path}/a.npy", range_bytes=1000)
    assert df.rdd.getNumPartitions() == 29  # 35 rows of 28 bytes a task
    got = df.orderBy("row").collect()
    assert [r.row for r in got] == list(range(1000)) and np.array_equal(np.array([r.embedding for r in got]), expected(1000, 7))
    assert np.array_equal(np.array([r.embedding for r in matrix.read_matrix(spark, f"{tmp_path}/b.bin", range_bytes=999).orderBy("row").collect()]), expected(500, 7).astype("<f2"))
    assert matrix.read_matrix(spark, f"{tmp_path}/*.*").count() == 1500
    some = matrix.read_matrix(spark, f"{tmp_path}/a.npy", range_bytes=1000, first=990, rows=100, columns=["row"])
    assert some.columns == ["row"] and sorted(r.row for r in some.collect()) == list(range(990, 1000))
    bare = matrix.read_matrix(spark, f"{tmp_path}/bare", dim=4, dtype="<f8")
    assert np.array_equal(np.array([r.embedding for r in bare.orderBy("row").collect()]), expected(20, 4))
    with pytest.raises(Exception, match="no dim is given"):
        matrix.read_matrix(spark, f"{tmp_path}/bare").collect()


def test_a_large_file_in_eight_tasks(spark, tmp_path):
    """3 GB of rows, sparse on disk: partitions are planned from the header alone, and no task is over a range."""
    n, dim = 786_432, 1024
    with open(tmp_path / "big.npy", "wb") as f:
        f.write(single.npy_header(n, dim, "<f4"))
        f.truncate(f.tell() + n * dim * 4)
    reader = matrix.MatrixReader(spark.range(0).selectExpr("id as row").schema, {"path": f"{tmp_path}/big.npy", "rangebytes": str(3 * (1 << 30) // 8)})
    parts = reader.partitions()
    assert len(parts) == 8 and sum(p.n for p in parts) == n and max(p.n for p in parts) * dim * 4 <= 3 * (1 << 30) // 8
    last = next(iter(matrix.MatrixReader(matrix_schema(spark), {"path": f"{tmp_path}/big.npy", "first": str(n - 2)}).read(matrix.Rows(f"{tmp_path}/big.npy", 128, dim, "<f4", n - 2, 2))))
    assert last.column("row").to_pylist() == [n - 2, n - 1]


def matrix_schema(spark):
    return spark.createDataFrame([], matrix.SCHEMA).schema


def test_filters_become_rows(spark, tmp_path):
    np.save(tmp_path / "a.npy", expected(100, 2))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = matrix.read_matrix(spark, f"{tmp_path}/a.npy", range_bytes=80)
        assert sorted(r.row for r in df.where("row >= 10 and row < 35 and row <> 12").collect()) == [10, 11, *range(13, 35)]
        assert df.where("row = 7").rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_text_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, f"line {k} é" if k % 7 else None) for k in range(200)], "k int, text string").repartition(7)
    assert single.write_text(df, f"{tmp_path}/t.txt", ["k"], parts=5) == 200
    with open(f"{tmp_path}/t.txt", encoding="utf-8") as f:
        assert f.read() == "".join((f"line {k} é" if k % 7 else "") + "\n" for k in range(200))


def test_archives(spark, tmp_path):
    items = {f"n{k:03}é": os.urandom(k * 3) for k in range(120)}
    df = spark.createDataFrame([(n, bytearray(d)) for n, d in items.items()], "name string, data binary").repartition(4)
    manifest = single.write_archive(df, f"{tmp_path}/a.zip", parts=6)
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        assert z.testzip() is None and z.namelist() == sorted(items) and all(z.read(n) == d for n, d in items.items())
    raw = (tmp_path / "a.zip").read_bytes()
    assert {r.name: raw[r.first_byte : r.first_byte + r.length] for r in manifest.collect()} == items
    more = spark.createDataFrame([("n001é", bytearray(b"other")), ("z", bytearray(b"new"))], "name string, data binary")
    second = single.write_archive(more, f"{tmp_path}/b.zip", parts=2)
    whole = single.merged([(manifest, f"{tmp_path}/a.zip"), (second, f"{tmp_path}/b.zip")], f"{tmp_path}/c.zip", parts=3)
    with zipfile.ZipFile(f"{tmp_path}/c.zip") as z:
        assert {n: z.read(n) for n in z.namelist()} == items | {"z": b"new"}
    assert {r.name: bytes(r.data) for r in single.read_items(whole, f"{tmp_path}/c.zip").collect()} == items | {"z": b"new"}
    with pytest.raises(ValueError):
        single.write_archive(more.union(more), f"{tmp_path}/d.zip")
    single.write_archive(more.limit(0), f"{tmp_path}/e.zip")
    assert zipfile.ZipFile(f"{tmp_path}/e.zip").namelist() == []
