"""Every registered query with SQL equals it; goldens of the operators that have none."""

import math

import pytest

from weirline.functions import nested
from weirline.functions import text as X
from weirline.operators import dedup, filters, mining
from weirline.plans import registry
from weirline.sources import io

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    want = duck.sql(registry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted((tuple(map(norm, r)) for r in want.select(*(f'"{c}"' for c in cols)).fetchall()), key=key)


def test_samples(spark, sf):
    q = registry.queries()
    rows = q["srt_hash_sample"](spark, sf).collect()
    assert {r.lang for r in rows} == {"en", "de", "fr", "es"} and len(rows) <= 80 and rows == q["srt_hash_sample"](spark, sf).collect()
    assert sum(r.n for r in q["snk_hash_shards"](spark, sf).collect()) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_gate_and_text_goldens(spark):
    F = X.F
    one = lambda t, **k: spark.createDataFrame([(t,)], "t string").select(X.quality_reason(F.col("t"), **k).alias("r")).first().r
    assert one("Six plain words make a line") is None and one("brief", min_chars=50) == "min" and one("lengthy", max_chars=3, min_chars=1) == "max"
    assert one("withoutanyspaceinit") == "space_low" and one("a b c " + "Ä" * 40) == "run"
    row = spark.createDataFrame([("see http://www.example.com/x?y=1 there",)], "t string").select(X.replace_urls(F.col("t"), "_").alias("u"), X.script(F.col("t"))["script"].alias("s"), X.ngrams(F.lit("ab cd"), 3).alias("g")).first()
    assert (row.u, row.s, row.g) == ("see _ there", "Latn", ["abc", "bcd"])


def test_nested_goldens(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, None), (3, [])], "id int, v array<int>")
    assert sorted(map(tuple, nested.explode_with_null(df, "v").collect()), key=str) == [(1, 1), (1, 2), (1, 3), (2, None)]
    assert [r.c for r in df.select(nested.chunks(nested.F.col("v"), 2).alias("c")).collect()] == [[[1, 2], [3]], [None], [[]]]


def test_staged_dedup_and_scores(spark):
    df = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, "b", "x"), (3, "b", "y"), (4, "c", "y")], "i int, s string, t string")
    assert [r.i for r in dedup.staged(df, "s", "t", ["i"], 1, 1).orderBy("i").collect()] == [0, 3]
    sc = spark.createDataFrame([(None,), (0.0,), (1.0,), (2.0,)], "x double")
    assert sc.where(filters.score_at_least(filters.F.col("x"), 1.5)).count() == 3


def test_mining_finds_planted_pairs(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(30, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    a = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    b = spark.createDataFrame([(100 + i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    got = mining.mine(a, b, 4, 1.2).collect()
    assert {(r.src_id, r.tgt_id) for r in got} >= {(i, 100 + i) for i in range(30)}


def test_io_round_trips(spark, tmp_path):
    assert (io.parse_size("10KB"), io.parse_size("10K"), io.parse_size("10PB")) == (10_000, 10_240, 10 * 1000**5)
    df = spark.createDataFrame([(i, f"n{i}", i % 3) for i in range(30)], "i int, name string, cat int")
    io.write_parquet(df, f"{tmp_path}/p", ["cat"], 4)
    assert sorted(map(tuple, io.read_parquet(spark, f"{tmp_path}/p", columns=["i"], where="cat = 1").collect())) == [(i,) for i in range(1, 30, 3)]
    io.write_delimited(df, f"{tmp_path}/t", compression="gzip")
    assert sorted(io.read_delimited(spark, f"{tmp_path}/t", "i int, name string, cat int").collect()) == sorted(df.collect())
    (tmp_path / "a.txt").write_text("x\ny\nz\n")
    (tmp_path / "b.txt").write_text("1\n2\n3\n")
    z = io.zip_lines(io.read_lines(spark, f"{tmp_path}/a.txt"), io.read_lines(spark, f"{tmp_path}/b.txt"))
    assert sorted((r.src, r.tgt) for r in z.collect()) == [("x", "1"), ("y", "2"), ("z", "3")]


def test_stream_resumes(spark, tmp_path):
    from weirline.streaming.resume import map_files

    schema = "i int"
    for k in range(2):
        spark.range(k * 5, k * 5 + 5).selectExpr("cast(id as int) as i").write.mode("append").parquet(f"{tmp_path}/in")
        map_files(spark, f"{tmp_path}/in", schema, lambda df: df.selectExpr("i * 2 as i"), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert sorted(r.i for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(0, 20, 2))


def test_knn_keeps_lowest_ids_of_equal_vectors(spark):
    q = spark.createDataFrame([(1, [0.6, 0.8])], "id long, vec array<double>")
    rows = [(i, [0.6, 0.8]) for i in range(400, 0, -1)] + [(i, [0.8, 0.6]) for i in range(401, 500)]
    base = spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)
    assert [(r.b_id, r.rank) for r in mining.knn(q, base, 4).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_state_machine_queries_without_sql(spark, sf):
    from weirline.operators import sequences as S

    q = registry.queries()
    ev = spark.read.parquet(f"{sf}/events.parquet").orderBy("user_id", "ts", "event_id").toPandas()
    ev["value"] = ev["value"].fillna(0.0)
    for name, plain in (("win_divide", lambda v: S.divide(v.to_numpy() / 200, 20, 3, 0.1)),):
        want = {(int(u), a, b) for u, g in ev.groupby("user_id") for a, b in plain(g["value"])}
        assert {(r.user_id, r.first, r.last) for r in q[name](spark, sf).collect()} == want
    p = q["udf_logistic_folds"](spark, sf)
    assert p.count() > 10 and p.where("probability < 0 or probability > 1").count() == 0
    assert sum(r.n for r in q["cnt_kmeans"](spark, sf).collect()) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    pairs = q["jn_optimal_assignment"](spark, sf).collect()
    assert len({(r.conv_id, r.turn, r.i) for r in pairs}) == len(pairs) == len({(r.conv_id, r.turn, r.j) for r in pairs})
    rising = sorted((r.conv_id, r.turn, r.i, r.j) for r in q["jn_monotone_alignment"](spark, sf).collect())
    assert all(a[:2] != b[:2] or a[3] < b[3] for a, b in zip(rising, rising[1:]))
    assert q["udf_word_alignment"](spark, sf).count() > 0 and q["udf_hash_embeddings"](spark, sf).count() > 0
    assert {r.rank for r in q["jn_ivf"](spark, sf).collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("name", ["arr_leaves", "vec_l2_normalize"])
def test_zeros_have_no_sign(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    spark.createDataFrame([(1, [-1e-7, 0.6, 0.8, -1e-7, 0.0])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    assert [repr(tuple(r)) for r in df.collect()] == [repr(r) for r in con.sql(registry.oracle_sql()[name]).select(*df.columns).fetchall()]


@pytest.mark.parametrize("name", ["src_epoch_rows", "src_epoch_tokens"])
def test_epochs_equal_sql_where_the_least_lengths_tie(spark, tmp_path, name):
    """A step of 192 rows whose two least lengths are 58: 58 * 0.809 + 58 * 0.191 in floating point is below 58."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, "x" * (58 if i % 192 < 2 else 61 + i % 150)) for i in range(384)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    got = sorted(map(tuple, df.collect()))
    assert len(got) > 100 and got == sorted(con.sql(registry.oracle_sql()[name]).select(*df.columns).fetchall())


def test_chunks_work_their_list_out_once(spark):
    """A list that an expression makes is bound before it is cut, so that a text is not split again for each of its chunks."""
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.repeat(F.lit("a "), 20).alias("t"))
    cut = df.select(nested.chunks(F.split("t", " "), 5).alias("c"))
    plan = cut._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and [len(x) for x in cut.first().c] == [5, 5, 5, 5, 1]


def test_bleu_counts_where_the_texts_are(spark):
    """Clipped counts by row, rows of one key together, missing lengths and null texts as before; no n-gram is exchanged."""
    from weirline.operators import scoring

    rows = [(1, 1, "a b a b c", "a b d a"), (1, 2, "x", "x y"), (1, 2, "x z", "z"), (1, 3, None, "q"), (2, 1, "p q", "r s"), (3, 1, "", "t")]
    df = spark.createDataFrame(rows, "g int, i int, h string, r string")
    out = scoring.corpus_bleu(df, ["g"], ["i"], "h", "r")
    # an n-gram that the references lack counts in full, as least() over a null does in the SQL: g 1 loses a "b" and an "x" of 8 and one "a b" of 5
    mean = (math.log(6 / 8) + math.log(4 / 5)) / 4
    got = {r.g: r.bleu for r in out.collect()}
    assert set(got) == {1, 2} and abs(got[1] - 100 * math.exp(mean) * math.exp(min(0.0, 1 - 8 / 8))) < 1e-9
    assert "gram" not in out._jdf.queryExecution().executedPlan().toString()
