import pytest

from weirline.functions import numerals as N


@pytest.mark.parametrize(
    ("number", "words"),
    [("0", "零"), ("2", "二"), ("10", "十"), ("12", "十二"), ("20", "二十"), ("105", "一百零五"), ("200", "两百"), ("222", "两百二十二"), ("1010", "一千零一十"), ("2222", "两千两百二十二"),
     ("10005", "一万零五"), ("12345678", "一千两百三十四万五千六百七十八"), ("100000000", "一亿"), ("1000005000", "十亿零五千"), ("3.14", "三点一四"), ("0.5", "零点五"), ("100", "一百")],
)
def test_chinese_numbers(number, words):
    assert N.chinese_number(number) == words


@pytest.mark.parametrize(
    ("text", "said"),
    [
        ("1999年2月20日", "一九九九年二月二十日"), ("08年8月8号", "零八年八月八号"), ("12月", "十二月"),
        ("34.56元", "三十四点五六元"), ("3块5毛", "三块五毛"), ("300万元", "三百万元"),
        ("电话13588881234。", "电话一三五八八八八一二三四。"), ("010-51628888", "零一零五一六二八八八八"), ("+86 19859213959", "八六一九八五九二一三九五九"),
        ("3/4的人", "四分之三的人"), ("62%", "百分之六十二"), ("5.5％", "百分之五点五"), ("共465篇，约315万字", "共四百六十五篇，约三百一十五万字"),
        ("12个苹果", "十二个苹果"), ("2个", "二个"), ("编号12345", "编号一二三四五"), ("B2B", "B2B"), ("共123", "共一百二十三"), ("没有", "没有"), ("", ""),
    ],
)
def test_chinese_texts(text, said):
    assert N.chinese_text(text) == said


@pytest.mark.parametrize(
    ("number", "words"),
    [("0", "শূন্য"), ("7", "সাত"), ("99", "নিরানব্বই"), ("100", "এক শত"), ("1999", "এক হাজার নয় শত নিরানব্বই"), ("2500000", "পঁচিশ লক্ষ"), ("123456789", "বার কোটি চৌত্রিশ লক্ষ ছাপ্পান্ন হাজার সাত শত ঊননব্বই"),
     ("1230000000", "এক শত তেইশ কোটি"), ("3.05", "তিন দশমিক শূন্য পাঁচ")],
)
def test_bengali_numbers(number, words):
    assert N.bengali_number(number) == words


def test_every_whole_number_is_told_apart():
    assert len(N.BENGALI) == 100 and len({N.bengali_number(str(n)) for n in range(30_000)}) == 30_000
    assert len({N.chinese_number(str(n)) for n in range(30_000)}) == 30_000


def test_columns(spark):
    df = spark.createDataFrame([("৩টি ১,২০০ টাকা",), ("12 টি",), ("কিছু না",), (None,)], "t string")
    assert [r[0] for r in df.select(N.numbers_in_words(df.t, "bn")).collect()] == ["তিনটি এক হাজার দুই শত টাকা", "বার টি", "কিছু না", None]
    zh = spark.createDataFrame([("12个",), (None,)], "t string")
    assert [r[0] for r in zh.select(N.numbers_in_words(zh.t, "zh")).collect()] == ["十二个", None]
