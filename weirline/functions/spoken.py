"""Numbers as English words and phrases of bounded length: small helpers inside Arrow batches; texts without a digit stay in the JVM."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ["", " thousand", " million", " billion", " trillion", " quadrillion"]
ORDINALS = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}


def below_hundred(n: int) -> str:
    return ONES[n] if n < 20 else TENS[n // 10] + (f"-{ONES[n % 10]}" if n % 10 else "")


def below_thousand(n: int) -> str:
    head = f"{ONES[n // 100]} hundred" if n >= 100 else ""
    return f"{head} {below_hundred(n % 100)}".strip() if n % 100 or not head else head


def cardinal(n: int) -> str:
    """1234567 as one million, two hundred thirty-four thousand, five hundred sixty-seven; digit by digit beyond the scales."""
    if n >= 1000 ** len(SCALES):
        return " ".join(ONES[int(c)] for c in str(n))
    parts, k = [], 0
    while n or not parts:
        n, low = divmod(n, 1000)
        if low or not (n or parts):
            parts.append(below_thousand(low) + SCALES[k])
        k += 1
    return ", ".join(reversed(parts))


def ordinal(n: int) -> str:
    head, sep, last = re.fullmatch(r"(.*?)([ -]?)([a-z]+)", cardinal(n)).groups()
    return head + sep + (ORDINALS.get(last) or (f"{last[:-1]}ieth" if last.endswith("y") else f"{last}th"))


def year_like(n: int) -> str:
    """1001 to 2999 as years are read: nineteen eighty-four, nineteen oh five, nineteen hundred, two thousand five."""
    if n == 2000 or not 1000 < n < 3000:
        return cardinal(n)
    if 2000 < n < 2010:
        return f"two thousand {ONES[n % 100]}"
    if n % 100 == 0:
        return f"{below_hundred(n // 100)} hundred"
    return f"{below_hundred(n // 100)} {'oh ' if n % 100 < 10 else ''}{below_hundred(n % 100)}"


def money(match: re.Match) -> str:
    parts = match[1].split(".")
    if len(parts) > 2:
        return f"{match[1]} dollars"
    whole, cents = int(parts[0] or 0), int(parts[1] or 0) if len(parts) > 1 else 0
    said = ([f"{whole} {'dollar' if whole == 1 and cents else 'dollars'}"] if whole else []) + ([f"{cents} {'cent' if cents == 1 else 'cents'}"] if cents else [])
    return ", ".join(said) or "zero dollars"


#: Spaces inside numbers: between groups of three digits, or (joined) between any digits.
GROUPED, ANY_SPACES = re.compile(r"(?<![0-9.,])[1-9][0-9]{0,2}(?: [0-9]{3})+(?![0-9])"), re.compile(r"[0-9][0-9 ]+[0-9]")
STEPS = (
    (re.compile(r"[0-9][0-9,.]*\s*%"), lambda m: m[0].replace(" ", "").replace("%", " percent")),
    (re.compile(r"[0-9][0-9,]+[0-9]"), lambda m: m[0].replace(",", "")),
    (re.compile(r"£([0-9]+)"), lambda m: f"{m[1]} pounds"),
    (re.compile(r"\$([0-9.]*[0-9]+)"), money),
    (re.compile(r"([0-9]+)\.([0-9]+)"), lambda m: f"{m[1]} point {' '.join(ONES[int(c)] for c in m[2])}"),
    (re.compile(r"([0-9]+)(?:st|nd|rd|th)\b"), lambda m: ordinal(int(m[1]))),
    (re.compile(r"[0-9]+"), lambda m: year_like(int(m[0]))),
)


def number_words(text: str, joined: bool = False) -> str:
    """Numbers of a text in words. Digits that spaces part are one number where they are groups of three, or always (joined)."""
    text = (ANY_SPACES if joined else GROUPED).sub(lambda m: m[0].replace(" ", ""), text)
    for pattern, say in STEPS:
        text = pattern.sub(say, text)
    return text


def expand_numbers(t: Column, joined: bool = False) -> Column:
    """Percents, pounds, dollars, decimals, ordinals, years and other numbers in words."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: number_words(x, joined), na_action="ignore")

    return F.when(t.rlike("[0-9]"), run(t)).otherwise(t)


def joined_phrases(parts: list[str], least: int, most: int) -> list[str]:
    """Phrases of which one of under `least` words joins the neighbour of fewer words; those over `most` take none up on their own."""
    parts, size, i = list(parts), lambda x: len(x.split()), 0
    while i < len(parts) and len(parts) > 1:
        n = size(parts[i])
        left = i - 1 if i and (i == len(parts) - 1 or size(parts[i - 1]) < size(parts[i + 1])) else i
        if n > most or n >= least:
            i += 1
            continue
        parts[left : left + 2] = [f"{parts[left]} {parts[left + 1]}"]
        i = left if left == i else i
    return parts


def phrases(t: Column, boundaries: str = "!?.,:;，。", least: int = 10, most: int = 20) -> Column:
    """Phrases of a text, cut behind each boundary, short ones joined with a neighbour."""
    mark = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in boundaries) + "]"
    cut = F.filter(F.transform(F.split(F.regexp_replace(t, f"({mark})", "$1\t"), "\t"), lambda x: F.trim(x)), lambda x: x != "")

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: joined_phrases(x, least, most), na_action="ignore")

    return run(cut)
