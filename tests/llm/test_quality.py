import re
from collections import Counter

from weirline.llm import quality

SCHEMA = "kept string, doc_id long, text string, n_words string, _words string"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


TEXTS = [
    None,
    "",
    " \t\n\x0b",
    "one",
    "a b c d e f g h " * 3,
    "a b c d e f g h i a b c d e f g h",
    "x " * 4000,
    "the cat of the house and a dog\nin the end it was for the cat and the dog that we are here with all",
    "\n\nline\n line\nline\r\nline\n   \n   \n",
    "café \U0001f600 naïve ###$$ <b> |",
    "z" * 200_000,
    " ".join(f"w{i % 4001}" for i in range(20_000)),
    "    \x1c",
]


def test_counts_equal_plain_python(spark):
    docs = spark.createDataFrame([("k", i, t, "n", "w") for i, t in enumerate(TEXTS)], SCHEMA).select("doc_id", "text", "kept", "_words")
    got = {r.doc_id: r for r in quality.judged(docs, keep=["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        want = plain(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, i
        assert got[i].base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i].base_failed and got[i].kept)
    assert got[7].kept and not got[10].kept and got[10].reasons == ["few_words", "word_length"]


def test_filter_keeps_clashing_columns_and_rows(spark):
    good = TEXTS[7]
    rows = [("k", 1, good, "n", "w"), ("k", 1, good, "n", "w"), (None, None, good, None, None), ("k", 2, None, "n", "w")]
    out = quality.filtered(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["kept", "doc_id", "text", "n_words", "_words"]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(rows[:3], key=str)
    assert quality.filtered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python_and_no_shuffle(spark):
    plan = quality.judged(spark.createDataFrame([("k", 1, "t", "n", "w")], SCHEMA).select("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_texts_of_other_languages_pass_the_stop_word_rule(spark):
    text = " ".join(f"słowo{i}" for i in range(40))
    rows = [(0, text, "pl"), (1, text, None), (2, text, "en"), (3, "the cat and the dog of it " + text, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [r.kept for r in quality.judged(df, keep=["doc_id"]).orderBy("doc_id").collect()] == [True, True, False, True]
    assert sorted(r.doc_id for r in quality.filtered(df).collect()) == [0, 1, 3]
    assert quality.filtered(df.drop("lang")).count() == 4 and quality.filtered(df.withColumnRenamed("lang", "n_words")).count() == 4
