import random
import time

import pytest
import regex

from weirline.functions import text as X
from weirline.operators import phrases as P

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def tokens(s):
    for a, b in X.UNICODE_PUNCT.items():
        s = s.replace(a, b)
    return " " + " ".join(regex.sub(r"(\p{P}|\p{S}|\p{Han})", r" \1 ", s.strip()).split()) + " "


def plain(text, listed):
    every = {t for p in listed for t in (tokens(p), tokens(p).lower()) if t.strip()}
    own = tokens(text or "")
    return sorted({p.strip() for p in every if p in own or p in own.lower()})


TEXTS = ["it's a well-known f*ck up", "WELL - KNOWN", "well—known", "a b　c", "xf*ckx", "漢字 here", None, "", "  ", "it’s “quoted”", "Foo foo FOO", "don't. Stop", "a b c d", "straße STRASSE İ"]
LISTED = ["f*ck", "well-known", "it's", "a b", "漢", "Foo", "don't.", "“quoted”", "c d", "straße", " ", "it's a well"]


def frames(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return df, spark.createDataFrame([(p,) for p in LISTED], "phrase string")


def test_phrases_are_cut_like_texts(spark):
    df, listed = frames(spark)
    want = {k: plain(t, LISTED) for k, t in enumerate(TEXTS)}
    assert want[0] == ["a b", "f * ck"] or {"f * ck", "it ' s", "well - known", "it ' s a well"} <= set(want[0])
    found = {r.id: r.phrases for r in P.with_phrases(df, "id", "text", listed).collect()}
    assert found == want
    few = df.select("id", X.toxic_words(df.text, [p for p in LISTED if p.strip()]).alias("w")).collect()
    assert {r.id: sorted(r.w) for r in few} == want


def test_long_lists_are_joined(spark, monkeypatch):
    df, listed = frames(spark)
    want = {k: plain(t, LISTED) for k, t in enumerate(TEXTS)}
    monkeypatch.setattr(P, "SHIPPED", 10)
    assert {r.id: r.phrases for r in P.with_phrases(df, "id", "text", listed).collect()} == want


def test_no_phrases(spark):
    df, listed = frames(spark)
    assert all(r.phrases == [] for r in P.with_phrases(df, "id", "text", listed.limit(0)).collect())


def test_pieces(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(MODEL)
    df, listed = frames(spark)

    def cut(s):
        for a, b in X.UNICODE_PUNCT.items():
            s = s.replace(a, b)
        return " " + " ".join(" ".join(sp.EncodeAsPieces(s.strip(" "))).split()) + " "

    every = {t for p in LISTED for t in (cut(p), cut(p).lower()) if t.strip()}
    want = {k: sorted({p.strip() for p in every if p in cut(t or "") or p in cut(t or "").lower()}) for k, t in enumerate(TEXTS)}
    got = {r.id: r.phrases for r in P.with_piece_phrases(df, "text", listed, MODEL).collect()}
    assert got == want and any(want.values())


def test_cost_does_not_grow_with_the_list(spark, sf):
    """Ten thousand phrases take at most twice the time of ten."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").select("doc_id", "text").cache()
    docs.count()
    r = random.Random(1)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(10_000)]
    took = []
    for n in (10, 10, 10_000):
        listed = spark.createDataFrame([(w,) for w in words[:n]], "phrase string")
        began = time.time()
        P.with_phrases(docs, "doc_id", "text", listed).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    docs.unpersist()
    assert took[2] < 2 * took[1] + 2, took
