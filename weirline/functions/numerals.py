"""Chinese and Bengali numbers in words, and the Chinese reading of dates, money, phones, fractions, percents and counted things."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weirline.functions.text import by_value

# Chinese digits and units by power of ten.
DIGITS = "零一二三四五六七八九"
UNITS = {1: "十", 2: "百", 3: "千", 4: "万", 8: "亿", 16: "兆"}
POINT, PERCENT, OVER = "点", "百分之", "分之"
# What makes a number a sum of money, and measure words that make it a count.
CURRENCY = "(?:(?:亿|千万|百万|万|千|百)?(?:元|块)|亿|千万|百万|万|千|百|角|毛|分)"
MEASURES = (
    "(?:[千毫微]克|[千分厘毫微]米|[匹张座回场尾条个首阙阵网炮顶丘棵只支袭辆挑担颗壳窠曲墙群腔砣客贯扎捆刀令打手罗坡山岭江溪钟队单双对出口头脚板跳枝件贴"
    "针线管名位身堂课本页家户层丝毫厘分钱两斤铢石钧锱忽寸尺丈里寻常铺程撮勺合升斗盘碗碟叠桶笼盆盒杯斛锅簋篮罐瓶壶卮盏箩箱煲啖袋钵年月日季刻时周天秒旬"
    "纪岁世更夜春夏秋冬代伏辈丸泡粒幢堆根道面片块])"
)
MOBILE = r"(?<!\d)(?:\+?86 ?)?1(?:[38]\d|5[0-35-9]|7[678]|9[89])\d{8}(?!\d)"
LANDLINE = r"(?<!\d)(?:0(?:10|2[1-3]|[3-9]\d{2})-?)?[1-9]\d{6,7}(?!\d)"

# Bengali words of 0 to 99 and of the units.
BENGALI = (
    "শূন্য এক দুই তিন চার পাঁচ ছয় সাত আট নয় দশ এগারো বার তের চৌদ্দ পনের ষোল সতের আঠার উনিশ "
    "বিশ একুশ বাইশ তেইশ চব্বিশ পঁচিশ ছাব্বিশ সাতাশ আঠাশ ঊনত্রিশ ত্রিশ একত্রিশ বত্রিশ তেত্রিশ চৌত্রিশ পঁয়ত্রিশ ছত্রিশ সাঁইত্রিশ আটত্রিশ ঊনচল্লিশ "
    "চল্লিশ একচল্লিশ বিয়াল্লিশ তেতাল্লিশ চুয়াল্লিশ পঁয়তাল্লিশ ছেচল্লিশ সাতচল্লিশ আটচল্লিশ ঊনপঞ্চাশ পঞ্চাশ একান্ন বায়ান্ন তিপ্পান্ন চুয়ান্ন পঞ্চান্ন ছাপ্পান্ন সাতান্ন আটান্ন ঊনষাট "
    "ষাট একষট্টি বাষট্টি তেষট্টি চৌষট্টি পঁয়ষট্টি ছেষট্টি সাতষট্টি আটষট্টি ঊনসত্তর সত্তর একাত্তর বাহাত্তর তিয়াত্তর চুয়াত্তর পঁচাত্তর ছিয়াত্তর সাতাত্তর আটাত্তর ঊনআশি "
    "আশি একাশি বিরাশি তিরাশি চুরাশি পঁচাশি ছিয়াশি সাতাশি আটাশি ঊননব্বই নব্বই একানব্বই বিরানব্বই তিরানব্বই চুরানব্বই পঁচানব্বই ছিয়ানব্বই সাতানব্বই আটানব্বই নিরানব্বই"
).split()
KOTI, BENGALI_UNITS, BENGALI_POINT = (10_000_000, "কোটি"), ((100_000, "লক্ষ"), (1000, "হাজার"), (100, "শত")), "দশমিক"


def spelled(digits: str) -> str:
    """Digits one by one."""
    return "".join(DIGITS[int(c)] if c.isdigit() else POINT if c == "." else "" for c in digits)


def _places(digits: str) -> list[int | str]:
    """Digits and powers of ten (as text keys of UNITS) that say a whole number; leading zeros are one zero."""
    value = digits.lstrip("0")
    if not value:
        return []
    zero = [0] * (len(value) < len(digits))
    if len(value) == 1:
        return [*zero, int(value)]
    power = max(p for p in UNITS if p < len(value))
    return [*zero, *_places(value[:-power]), UNITS[power], *_places(value[-power:])]


def chinese_number(number: str) -> str:
    """A number in Chinese: ten thousands and hundred millions, 两 for two before a unit over ten, 十 for one ten at the front."""
    whole, _, rest = number.partition(".")
    said = _places(whole) if len(whole) > 1 else [int(c) for c in whole]
    words = []
    for k, x in enumerate(said):
        before, after = said[k - 1] if k else None, said[k + 1] if k + 1 < len(said) else None
        large = isinstance(after, str) and after != UNITS[1] and (before is None or isinstance(before, str) and before != UNITS[1])
        words.append(x if isinstance(x, str) else "两" if x == 2 and large else DIGITS[x])
    text = "".join(words) or DIGITS[0]
    text = text[1:] if text.startswith(DIGITS[1] + UNITS[1]) else text
    return text + (POINT + spelled(rest) if rest else "")


def _each(match: re.Match) -> str:
    return re.sub(r"\d+(?:\.\d+)?", lambda m: chinese_number(m[0]), match[0])


def _date(match: re.Match) -> str:
    year, rest = re.fullmatch(r"(?:(\d+)年)?(.*)", match[0]).groups()
    return (spelled(year) + "年" if year else "") + re.sub(r"\d+", lambda m: chinese_number(m[0]), rest)


NUMBER = r"(?<![\d.])\d+(?:\.\d+)?"
CHINESE_STEPS: tuple[tuple[re.Pattern, Callable], ...] = (
    (re.compile(r"(?<!\d)(?:(?:[089]\d|(?:19|20)\d{2})年(?:\d{1,2}月(?:\d{1,2}[日号])?)?|\d{1,2}月(?:\d{1,2}[日号])?)"), _date),
    (re.compile(rf"{NUMBER}[多余几]?{CURRENCY}(?:\d{CURRENCY}?)?"), _each),
    (re.compile(MOBILE), lambda m: spelled(m[0])),
    (re.compile(LANDLINE), lambda m: spelled(m[0])),
    (re.compile(r"(\d+)/(\d+)"), lambda m: chinese_number(m[2]) + OVER + chinese_number(m[1])),
    (re.compile(r"(\d+(?:\.\d+)?)[%％]"), lambda m: PERCENT + chinese_number(m[1])),
    (re.compile(rf"{NUMBER}(?=[多余几]?{MEASURES})"), lambda m: chinese_number(m[0])),
    (re.compile(r"\d{4,32}"), lambda m: spelled(m[0])),
    (re.compile(r"\d+(?:\.\d+)?"), lambda m: chinese_number(m[0])),
)


def chinese_text(text: str) -> str:
    """All numbers of a text in Chinese words; the 2 between letters (as in B2B) stays."""
    held = re.sub(r"(?<=[a-zA-Z])2(?=[a-zA-Z])", "\0", text)
    for pattern, say in CHINESE_STEPS:
        held = pattern.sub(say, held)
    return held.replace("\0", "2")


def bengali_number(number: str) -> str:
    """A number in Bengali: crores (in words themselves beyond 99), lakhs, thousands, hundreds; digits one by one behind the point."""
    whole, _, rest = number.partition(".")
    n, words = int(whole or 0), []
    if n >= KOTI[0]:
        words += [bengali_number(str(n // KOTI[0])), KOTI[1]]
        n %= KOTI[0]
    for size, name in BENGALI_UNITS:
        if n >= size:
            words += [BENGALI[n // size], name]
            n %= size
    if n or not words:
        words.append(BENGALI[n])
    if rest:
        words += [BENGALI_POINT, *(BENGALI[int(c)] for c in rest)]
    return " ".join(words)


def bengali_text(text: str) -> str:
    """Numbers of a text (either kind of digits, commas inside) in Bengali words."""
    western = text.translate({0x9E6 + k: str(k) for k in range(10)})
    return re.sub(r"\d+(?:,\d+)*(?:\.\d+)?", lambda m: bengali_number(m[0].replace(",", "")), western, flags=re.ASCII)


SPEAKERS = {"zh": chinese_text, "bn": bengali_text}


def numbers_in_words(t: Column, lang: str) -> Column:
    """A text with its numbers in words of zh or bn; texts without a digit don't reach Python."""
    run = by_value(lambda: SPEAKERS[lang], "string", pa.string())
    return F.when(t.rlike("[0-9\\x{9e6}-\\x{9ef}]"), run(t)).otherwise(t)
