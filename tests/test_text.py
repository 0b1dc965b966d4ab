"""Values of normalisers, splitters, scripts and languages, written down from their rules."""

import pytest
from pyspark.sql import functions as F

from weirline.functions import sentences as S
from weirline.functions import text as X


def one(spark, value, f, *more):
    return spark.createDataFrame([(value, *more)], "t string" + "".join(f", c{k} string" for k in range(len(more)))).select(f(F.col("t"), *(F.col(f"c{k}") for k in range(len(more)))).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "key"),
    [("  C++ 3.5 ", "c++ 0.0"), ("„Ja“ – gut…", "ja  gut"), ("a\tb\x07", "ab"), ("٣ Äpfel", "0 äpfel"), ("１2", "00"), ("", ""), ("x ", "x")],
)
def test_dedup_key(spark, text, key):
    assert one(spark, text, X.dedup_key) == key


def test_normalisers(spark):
    assert one(spark, "，。►．１", X.replace_unicode_punct) == ',.-. "'
    assert one(spark, "«a» — b…", X.replace_unicode_punct) == '"a"  -  b...'
    assert one(spark, "«a»—b…►", X.remove_unicode_punct) == "ab"
    assert one(spark, "Ünïté ß ﬁ", X.strip_accents) == "Unite ß ﬁ"
    assert one(spark, " ﬁne  ① ", X.normalize_unicode) == "fine 1"
    assert one(spark, "a​b﻿\x00", X.replace_non_printing) == "a b  "
    assert one(spark, " Été 12 ”x” ", X.normalize) == 'ete 00 "x"'


def test_spacing_keeps_its_quirks(spark):
    f = X.normalize_spacing
    assert one(spark, "a (b).", f) == "a  (b\\)."
    assert one(spark, "5 % of ''x''", f) == '5\\% of  " x " '
    assert one(spark, '"yes",', f) == '"yes,\\"'
    assert one(spark, "1 000", f) == "1.000" and one(spark, "1 000", lambda t: f(t, "de")) == "1,000"
    assert one(spark, 'a," b', lambda t: f(t, "fr")) == 'a", b'


@pytest.mark.parametrize(
    ("text", "script", "share"),
    [("a latin line.", "Latn", 1.0), ("এটি বাংলা", "Beng", 1.0), ("এ 1234 b", None, 0.0), ("এ.ก,b గ", None, 0.0), ("12 ,.", None, 0.0), ("", None, 0.0), ("ab สวัสดี", "Thai", 6 / 8), ("ab ба", None, 0.0), ("abc ба", "Latn", 0.6)],
)
def test_script(spark, text, script, share):
    got = one(spark, text, X.script)
    assert got.script == script and abs(got.share - share) < 1e-9


def test_gate(spark):
    assert one(spark, "😀😀😀 ok text", X.quality_reason) == "emoji" and one(spark, "a\tb c\nd e f", X.quality_reason) == "space_high"
    assert one(spark, "words of all " + "y" * 22 + " kinds and more", X.quality_reason) == "run"
    assert one(spark, "more 😻😼😽 cats 👨‍👩‍👧 end 🇩🇪 1️⃣ x", X.remove_emoji) == "more cats end x"


def test_sentences(spark):
    assert one(spark, "One here. Two! three? Four… ¿Cinco", S.split_sentences) == ["One here.", "Two! three?", "Four…", "¿Cinco"]
    assert one(spark, "你好。再见!好", lambda t: S.split_sentences(t, "zho")) == ["你好。", "再见!", "好"]
    assert one(spark, "ሰላም፡፡ እንዴት", lambda t: S.split_sentences(t, "amh")) == ["ሰላም።", " እንዴት"]
    assert one(spark, "က။”ခ။", lambda t: S.split_sentences(t, "mya")) == ["ကAPOS။".replace("APOS။", "။”"), "ခ။"]
    assert one(spark, "Մեկ: Երկու: ", lambda t: S.split_sentences(t, "hye")) == ["Մեկ:", "Երկու:"]
    assert one(spark, "你好。再见", lambda t, c: S.split_by_language(t, c), "zho") == ["你好。", "再见"]
    assert one(spark, "one. two! three", S.split_caseless) == ["one.", "two!", "three"]
    assert one(spark, "It's 3 o'clock, né?", S.word_tokens) == ["It", "'", "s", "3", "o", "'", "clock", ",", "né", "?"]


def test_languages_and_speech(spark):
    assert one(spark, "the cat of the house", S.predict_language).lang == "en" and one(spark, "xyz", S.predict_language).prob == 0.0
    assert one(spark, "the der", lambda t: S.predict_language(t, {"de": 0.9, "en": 0.9})).lang == "__label__unk"
    fields = lambda c: tuple(one(spark, c, S.language_fields))
    assert fields("eng_Latn") == ("eng", "Latn", None) and fields("pt-BR") == ("pt", None, "BR") and fields("hi_IN_rom") == ("hi", "Latn", "IN") and fields("de") == ("de", None, None)
    assert one(spark, "Dr. Who (aside [x]) said: USA’s  No. 1!", S.clean_for_speech).split() == ["doctor", "who", "said", "usa's", "no", "1"]
    assert one(spark, "USA now", S.clean_for_speech) == "u s a now"
    assert one(spark, "Hello, [noise] WORLD (laughs)!", S.spoken_form) == "hello world"


def test_texts_of_a_batch_are_not_all_python_objects_at_once(spark, monkeypatch):
    """Results are packed every few values; nulls stay, an empty batch too."""
    import pyarrow as pa

    seen = []

    class Batch:
        def __init__(self, values):
            self.values = values

        def __len__(self):
            return len(self.values)

        def __getitem__(self, at):
            seen.append(len(self.values[at]))
            return pa.array(self.values[at], pa.string())

    run = X.by_value(lambda: str.upper, "string", pa.string()).func
    values = [None if k % 7 == 0 else f"t{k}" for k in range(600)]
    got = [x for b in run(iter([Batch(values), Batch([])])) for x in b.to_pylist()]
    assert got == [None if v is None else v.upper() for v in values] and max(seen) == X.HELD and len(seen) == 4


def test_clean_sentences_pass_by_the_cleaning_steps(spark):
    """cleaning gives what its steps give, and Python gets only what composition may change."""
    clean = ["", "Plain words, 3 of them.", "¿Qué tal? ¡Señor!", "À la fête: ça va, Größe ÿ"]
    unclean = ["two  spaces", " lead", "trail ", "tab\there", "line\n", "«quoted»", "e\u0301t\u00e9", "ﬁne ½ µ ª", "\xa0x", "´a", "x\x85", "日本、語", "\x1cx", "a\u2003b"]
    df = spark.createDataFrame([(x,) for x in [*clean, *unclean, None]], "t string")
    steps = X.normalize_unicode(X.remove_non_printing(X.replace_unicode_punct(F.col("t"))))
    got = {r.t: r for r in df.select("t", S.clean_sentence(F.col("t")).alias("a"), steps.alias("b"), (~S.is_clean(F.col("t"))).alias("u")).collect()}
    assert all(r.a == r.b for r in got.values()) and got[None].a is None
    assert [got[x].u for x in [*clean, *unclean]] == [False] * len(clean) + [True] * len(unclean)
    seen = spark.sparkContext.accumulator(0)
    run = X._vectorised(lambda x: seen.add(1) or x)
    assert df.where("t is not null").select(run(F.col("t")).alias("t")).collect() and seen.value == sum(not x.isascii() for x in [*clean, *unclean])
