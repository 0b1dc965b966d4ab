import math
import random

import pytest

from weirline.functions import sentences as S
from weirline.operators import lattice as L


def every_cut(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in every_cut(run[k:]):
            yield [run[:k], *rest]


def test_cheapest_of_all_cuts():
    r = random.Random(1)
    for _ in range(60):
        counts = {"".join(r.choices("กขค", k=r.randint(1, 4))): r.randint(1, 50) for _ in range(12)}
        lat, total = L.Lattice(counts), sum(counts.values())
        price = lambda w: math.log(total / counts[w]) if w in counts else math.log(total) + 10 if len(w) == 1 else math.inf  # noqa: E731, B023
        run = "".join(r.choices("กขคง", k=r.randint(1, 9)))
        best = min(round(sum(map(price, c)), 6) for c in every_cut(run))
        got = lat.cut(run)
        assert "".join(got) == run and abs(sum(map(price, got)) - best) < 1e-5


GOLDEN = {"我": 50, "来到": 20, "北京": 40, "清华": 10, "清华大学": 9, "华大": 2, "大学": 30, "ฉัน": 9, "รัก": 9, "ภาษา": 9, "ไทย": 9, "ภาษาไทย": 4}


def test_goldens(spark):
    texts = ["我来到北京清华大学", "ฉันรักภาษาไทย", "I love 北京, ok?", "未登录", "", None, " 我 我 "]
    want = [["我", "来到", "北京", "清华大学"], ["ฉัน", "รัก", "ภาษาไทย"], ["I", "love", "北京", ",", "ok", "?"], ["未", "登", "录"], [], None, ["我", "我"]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    listed = spark.createDataFrame([*GOLDEN.items(), ("", 3), ("我", 1)], "word string, n long")
    got = {r.id: r.words for r in L.dictionary_words(df, "text", listed).collect()}
    assert got == dict(enumerate(want))


def test_no_letter_is_lost_and_long_runs_are_cut(monkeypatch):
    r = random.Random(2)
    lat = L.Lattice(GOLDEN)
    for _ in range(50):
        text = "".join(r.choice([*GOLDEN, "x", " ", "。", "?", "未", "\n", "12"]) for _ in range(r.randint(0, 80)))
        assert "".join(lat.words(text)) == "".join(text.split())
    run = "".join(r.choices([*GOLDEN], k=500))
    whole = list(lat.cut(run))
    monkeypatch.setattr(L, "WINDOW", 60)
    assert lat.words(run) == whole


def test_large_dictionaries_are_refused(spark, monkeypatch):
    monkeypatch.setattr(L, "SHIPPED", 3)
    df = spark.createDataFrame([("我",)], "text string")
    with pytest.raises(ValueError):
        L.dictionary_words(df, "text", spark.createDataFrame([("北京", 1)], "word string, n long"))


def plain_urdu(text):
    """The rule word by word."""
    out = []
    for part in text.replace("۔", "۔\0").split("\0"):
        if len(part.split()) < 2:
            continue
        for piece in part.replace("؟", "؟\0").split("\0"):
            words, now, k = piece.split(), [], 0
            said = []
            while k < len(words):
                now.append(words[k])
                if words[k] in S.URDU_ENDS and k + 1 < len(words) and words[k + 1] not in S.URDU_JOINS:
                    if words[k + 1] in "۔،":
                        k += 1
                        now.append(words[k])
                    said.append(now)
                    now = []
                k += 1
            said.append(now)
            out += [" ".join(x) for x in said if len(x) >= 2]
    return out


def test_urdu_sentences(spark):
    r = random.Random(3)
    words = ["میں", "گھر", "ہے", "تھا", "اور", "کہ", "گے", "، ", "۔", "؟", "کتاب", "ہیں", "لیکن"]
    texts = ["یہ کتاب ہے اور وہ گھر ہے۔ کیا آپ ٹھیک ہیں؟ جی ہاں۔", ""] + [" ".join(r.choices(words, k=r.randint(0, 25))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {x.id: x.s for x in df.select("id", S.split_urdu(df.t).alias("s")).collect()}
    assert got == {k: plain_urdu(t) for k, t in enumerate(texts)}
    assert plain_urdu(texts[0]) == ["یہ کتاب ہے اور وہ گھر ہے۔", "کیا آپ ٹھیک ہیں؟", "جی ہاں۔"]
