import numpy as np

from weirline.llm import language


def test_held_out_accuracy_and_edges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"), sample=40)
    assert sorted(set(model.langs)) == ["de", "en", "es", "fr"] and len(model.langs) > 4
    got = docs.where("doc_id % 2 = 1").select("doc_id", "text", "lang").withColumnRenamed("lang", "real")
    pred = language.predict(got, model).join(got, language.F.col("id") == got.doc_id)
    rows = pred.collect()
    assert sum(r.lang == r.real for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    english = docs.where("lang = 'en' and n_chars > 1000").first().text * 200
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 _ 34 😀", "x"), (4, english, "x"), (5, "ЖЖЖ щщщ", "x"), (None, "der die das", "x")], "doc_id long, text string, lang string")
    by = {(r.id, r.score > 0): r for r in language.predict(odd, model).collect()}
    assert [by[i, False].lang for i in (1, 2, 3)] == ["und"] * 3 and by[4, True].lang == "en" and (None, True) in by
    assert any(r.rejected for r in by.values())


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.fit(empty)
    assert model.langs == [] and language.predict(empty, model).count() == 0
    one = language.predict(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first()
    assert (one.lang, one.score, one.rejected) == ("und", 0.0, True)


def test_cluster_is_unit_and_stable():
    v = np.abs(np.random.default_rng(0).normal(size=(50, 8))).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    c = language.cluster(v, 3)
    assert np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and (c == language.cluster(v, 3)).all()
    assert len(language.cluster(np.repeat(v[:1], 5, 0), 3)) == 1


def test_query_split_and_held_out_accuracy(spark, sf):
    import zlib

    from weirline.llm import queries

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op7_language(spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.9 * len(held) > 10
    assert all(r.lang_pred == "und" for r in got if not any(c.isalpha() for c in docs[r.doc_id].text or ""))
