import pytest
from pyspark.sql import functions as F

from weirline.functions import spoken as S


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("in 1984", "in nineteen eighty-four"),
        ("1905 1900 2000 2005 2024", "nineteen oh five nineteen hundred two thousand two thousand five twenty twenty-four"),
        ("1,234,567 or 12", "one million, two hundred thirty-four thousand, five hundred sixty-seven or twelve"),
        ("5% of $3.50", "five percent of three dollars, fifty cents"),
        ("$1.01 $1 $0 £20", "one dollar, one cent one dollars zero dollars twenty pounds"),
        ("3.14", "three point one four"),
        ("1st 2nd 21st 30th 112th", "first second twenty-first thirtieth one hundred twelfth"),
        ("0 100 1000000", "zero one hundred one million"),
        ("no digits", "no digits"),
    ],
)
def test_number_words(text, want):
    assert S.number_words(text) == want


def test_columns(spark):
    df = spark.createDataFrame([("7 cats",), (None,), ("none",)], "t string")
    assert [r.x for r in df.select(S.expand_numbers(F.col("t")).alias("x")).collect()] == ["seven cats", None, "none"]
    one = spark.createDataFrame([("One, two three four five. Six! seven eight nine",)], "t string")
    assert one.select(S.phrases(F.col("t"), least=3, most=5).alias("x")).first().x == ["One, two three four five.", "Six! seven eight nine"]


def test_phrases_keep_all_words_and_short_ones_join():
    assert S.joined_phrases(["a"], 3, 5) == ["a"] and S.joined_phrases([], 3, 5) == []
    assert S.joined_phrases(["a b c d", "e", "f g"], 3, 5) == ["a b c d", "e f g"]
    assert S.joined_phrases(["a", "b", "c"], 3, 5) == ["a b c"]
