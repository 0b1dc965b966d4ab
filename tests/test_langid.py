import math
import re
from collections import Counter

from pyspark.sql import functions as F

from weirline.operators import langid as L

LABELLED = [("en", "the cat and the dog, the house and the garden " * 3), ("de", "der Hund und die Katze, das Haus und der Garten " * 3), ("en", "a thing there and then"), (None, "the the the"), ("fr", None)]
TEXTS = ["the garden", "das ist der Garten", "", None, "123 !", "zzz", "e", "The HOUSE; the cat", "x" * 100_000]


def trigrams(t):
    x = " " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " "
    return [x[i : i + 3] for i in range(len(x) - 2)]


def plain(texts, least):
    counts = {}
    for lang, t in LABELLED:
        if lang and t:
            counts.setdefault(lang, Counter()).update(trigrams(t))
    counts = {k: {g: n for g, n in c.items() if n >= least} for k, c in counts.items()}
    v = len({g for c in counts.values() for g in c})
    out = []
    for t in texts:
        g = trigrams(t or "")
        if not (t or "") or not "".join(g).strip():
            out.append(None)
            continue
        s = {k: sum(math.log((c.get(x, 0) + 1) / (sum(c.values()) + v)) for x in g) for k, c in counts.items()}
        best, second = sorted(s, key=lambda k: (-s[k], k))[:2]
        out.append((best, 1 / sum(math.exp(x - s[best]) for x in s.values()), (s[best] - s[second]) / len(g)))
    return out


def test_equals_plain_bayes(spark):
    model = L.train(spark.createDataFrame(LABELLED, "lang string, text string"), "text", "lang", least=2)
    assert model.labels == ["de", "en"]
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(2)
    got = {r.id: r.p for r in df.select("id", L.predicted(df.text, model).alias("p")).collect()}
    for k, want in enumerate(plain(TEXTS, 2)):
        assert (got[k] is None) == (want is None)
        if want:
            assert got[k].label == want[0] and abs(got[k].prob - want[1]) < 1e-9 and abs(got[k].margin - want[2]) < 1e-9
    keep = df.select("id", L.accepted(L.predicted(df.text, model), F.lit("en"), {"en": 0.99}).alias("k"))
    assert {r.id for r in keep.where("k").collect()} == {0, 7}


def test_no_labels(spark):
    model = L.train(spark.createDataFrame([], "lang string, text string"), "text", "lang")
    df = spark.createDataFrame([("abc",)], "text string")
    assert df.select(L.predicted(df.text, model).alias("p")).first().p is None


def test_held_out_accuracy(spark, sf):
    d = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet").where("lang is not null and text is not null")
    model = L.train(d.where("doc_id % 5 <> 0"), "text", "lang")
    held = d.where("doc_id % 5 = 0 and length(text) > 100").select("lang", L.predicted(F.col("text"), model)["label"].alias("p"))
    assert held.where("lang = p").count() >= 0.95 * held.count()
