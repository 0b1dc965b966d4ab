"""Text expressions: normalisers, quality metrics and toxicity terms, Column to Column."""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation classes of the quality gate. The bar counts twice, as it is in both lists.
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
EXTRA_PUNCT = "—|–"
DIGITS = "0123456789"

# Unicode punctuation and what replaces it.
UNICODE_PUNCT = {
    "，": ",",
    "。": ".",
    "、": ",",
    "„": '"',
    "”": '"',
    "“": '"',
    "«": '"',
    "»": '"',
    "１": '"',
    "」": '"',
    "「": '"',
    "《": '"',
    "》": '"',
    "´": "'",
    "∶": ":",
    "：": ":",
    "？": "?",
    "！": "!",
    "（": "(",
    "）": ")",
    "；": ";",
    "–": "-",
    "—": " - ",
    "．": ". ",
    "～": "~",
    "’": "'",
    "…": "...",
    "━": "-",
    "〈": "<",
    "〉": ">",
    "【": "[",
    "】": "]",
    "％": "%",
    "►": "-",
}
ONE_TO_ONE = {a: b for a, b in UNICODE_PUNCT.items() if len(b) == 1}
LONGER = {a: b for a, b in UNICODE_PUNCT.items() if len(b) > 1}
WHITESPACE = " \t\n\r\x0b\x0c"
#: Letters that trimming takes off, where they are not control letters, which go anyway.
BLANK = "[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+"
CONTROL = "[\\x00-\\x1f\\x7f-\\x9f]"


def any_of(letters: str) -> str:
    """A character class of these letters, in a form that both Java and RE2 read."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in letters) + "]"


def count_class(t: Column, letters: str) -> Column:
    """Code points of t in a set of letters."""
    return F.regexp_count(t, F.lit(any_of(letters)))


def ratio(n: Column, t: Column) -> Column:
    return n / F.nullif(F.length(t), F.lit(0))


def punct_ratio(t: Column) -> Column:
    return ratio(count_class(t, ASCII_PUNCT) + count_class(t, EXTRA_PUNCT), t)


def number_ratio(t: Column) -> Column:
    return ratio(count_class(t, DIGITS), t)


def space_ratio(t: Column) -> Column:
    return ratio(count_class(t, WHITESPACE), t)


# Code points with the Unicode property Emoji, without digits, # and *; hexadecimal.
EMOJI_POINTS = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2 25AA-25AB 25B6 25C0 25FB-25FE
2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A 262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663
2665-2666 2668 267B 267E-267F 2692-2697 2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8
26CE-26CF 26D1 26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721 2728
2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935 2B05-2B07 2B1B-2B1C 2B50 2B55
3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E 1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A
1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397 1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E
1F550-1F567 1F56F-1F570 1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4
1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2 1F6D5-1F6D7 1F6DC-1F6E5
1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A 1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FA89
1FA8F-1FAC6 1FACE-1FADC 1FADF-1FAE9 1FAF0-1FAF8
"""
EMOJI = "[" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in EMOJI_POINTS.split()) + "]"
#: The same in a form in which most letters of most texts fail at once.
EMOJI_FAST = "(?:[\\xA9\\xAE]|(?=[\\x{203C}-\\x{1FAFF}])" + EMOJI.replace("\\x{A9}\\x{AE}", "") + ")"
#: Emoji with joined, tinted and flagged parts, keycaps too, and the white space behind them.
EMOJI_RUN = f"(?:(?:{EMOJI_FAST}|[\\x{{1F1E6}}-\\x{{1F1FF}}]{{2}}|[0-9#*]\\x{{FE0F}}?\\x{{20E3}})(?:[\\x{{FE0E}}\\x{{FE0F}}\\x{{200D}}\\x{{E0020}}-\\x{{E007F}}]|[\\x{{1F3FB}}-\\x{{1F3FF}}])*)+\\s*"


def remove_emoji(t: Column, by: str = "") -> Column:
    """Emoji, whole sequences at a time, with the white space that follows them."""
    return F.regexp_replace(t, EMOJI_RUN, by)


def emoji_ratio(t: Column) -> Column:
    return ratio(F.regexp_count(t, F.lit(EMOJI_FAST)), t)


def longest_run(t: Column) -> Column:
    """Length of the longest run of one letter."""
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(t, F.lit("((?s).)\\1*+"), F.lit(0)), F.length)), F.lit(0))


def has_run_over(t: Column, n: int) -> Column:
    """Whether some letter stands more than n times in a row; stops at the first."""
    return t.rlike(f"((?s).)\\1{{{n}}}")


def quality_reason(t: Column, min_chars=5, max_chars=500, punct=0.2, number=0.2, min_space=0.05, max_space=0.3, emoji=0.1, run=20) -> Column:
    """The first rule of the quality gate that t fails, in fixed order; null if it passes."""
    n = F.length(t)
    return (
        F.when(n < min_chars, "min")
        .when(n > max_chars, "max")
        .when(punct_ratio(t) > punct, "punct")
        .when(number_ratio(t) > number, "number")
        .when(space_ratio(t) < min_space, "space_low")
        .when(space_ratio(t) > max_space, "space_high")
        .when(emoji_ratio(t) > emoji, "emoji")
        .when(has_run_over(t, run), "run")
    )


def replace_unicode_punct(t: Column) -> Column:
    out = F.translate(t, "".join(ONE_TO_ONE), "".join(ONE_TO_ONE.values()))
    for a, b in LONGER.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def remove_unicode_punct(t: Column) -> Column:
    return F.translate(t, "".join([*ONE_TO_ONE, *LONGER]), "")


def remove_non_printing(t: Column) -> Column:
    return F.regexp_replace(t, CONTROL, "")


def stripped(t: Column) -> Column:
    return F.regexp_replace(t, f"^{BLANK}|{BLANK}$", "")


def dedup_key(t: Column) -> Column:
    """Key of equal texts: trimmed, lower case, digits as 0, without the punctuation of UNICODE_PUNCT and control letters."""
    low = F.regexp_replace(F.lower(stripped(t)), "\\p{Nd}", "0")
    out = F.translate(low, "".join(UNICODE_PUNCT) + "".join(map(chr, [*range(1, 32), *range(127, 160)])), "")
    return F.replace(out, F.lit("\x00"), F.lit(""))


def normalize(t: Column, accent: bool = True, case: bool = True, numbers: bool = True, punct: int = 1) -> Column:
    """General normaliser: accents stripped (outside the JVM), lower case, digits as 0, punctuation replaced (1) or removed (2)."""
    out = stripped(t)
    out = F.lower(out) if case else out
    out = strip_accents(out) if accent else out
    out = F.regexp_replace(out, "\\p{Nd}", "0") if numbers else out
    out = {1: replace_unicode_punct, 2: remove_unicode_punct}.get(punct, lambda x: x)(out)
    return remove_non_printing(out)


#: Values of a batch that are Python objects at a time.
HELD = 256


def by_value(make: Callable[[], Callable], kind: str, arrow: pa.DataType):
    """A function of one column by make()'s function of a value, made once a task; null stays null.

    A batch goes value by value and its results are packed every HELD of them, so that its texts are never held as Python objects all at once.
    """

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        each = lambda x: None if x is None else f(x)
        for b in batches:
            yield pa.concat_arrays([pa.array([each(x) for x in b[a : a + HELD].to_pylist()], arrow) for a in range(0, max(1, len(b)), HELD)])

    return run


def _vectorised(f):
    """f on the letters of each distinct non-ASCII text; ASCII texts stay in the JVM."""

    run = by_value(lambda: f, "string", pa.string())
    return lambda t: F.coalesce(run(F.when(F.octet_length(t) != F.length(t), t)), t)  # Python gets a null for the others: a branch would not keep them from it


def strip_accents(t: Column) -> Column:
    """Canonical decomposition without marks."""
    return _vectorised(lambda x: "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn"))(t)


def normalize_unicode(t: Column) -> Column:
    """Compatibility composition, then single spaces and none at the ends."""
    return F.regexp_replace(stripped(_vectorised(lambda x: unicodedata.normalize("NFKC", x))(t)), BLANK, " ")


def replace_non_printing(t: Column, by: str = " ") -> Column:
    """Letters of the categories control, format, surrogate, private use and unassigned."""
    return F.regexp_replace(t, "\\p{C}", by)


# The spacing normaliser's rules in order; `re` rules are regular expressions, the others literal.
SPACING = (
    ("\r", ""),
    ("(", " ("),
    (")", ") "),
    (" +", " "),
    ("re", r"\) ([.!:?;,])", r"\\)$1"),
    ("( ", "("),
    (" )", ")"),
    ("re", r"(\d) %", r"$1\\%"),
    (" :", ":"),
    (" ;", ";"),
    ("`", "'"),
    ("''", ' " '),
    ("„", '"'),
    ("“", '"'),
    ("”", '"'),
    ("–", "-"),
    ("—", " - "),
    (" +", " "),
    ("´", "'"),
    ("‘", '"'),
    ("‚", '"'),
    ("’", '"'),
    ("''", '"'),
    ("…", "..."),
    (" « ", ' "'),
    ("« ", '"'),
    ("«", '"'),
    (" » ", '" '),
    (" »", '"'),
    ("»", '"'),
    (" %", "%"),
    (" :", ":"),
    (" ?", "?"),
    (" !", "!"),
    (" ;", ";"),
    (" +", " "),
    ("．", ". "),
)
QUOTED_EN = ("re", r'"([,.]+)', r'$1\\"')
QUOTED_OTHER = ((',"', '",'), ("re", r'(\.+)"(\s*[^<])', r'\\"$1$2'))


def spacing_rules(language: str = "en") -> list[tuple]:
    """SPACING with the quotation and digit rules of a language."""
    quoted = {"en": [QUOTED_EN], "cs": [], "cz": []}.get(language, list(QUOTED_OTHER))
    mark = "," if language in ("de", "es", "cz", "cs", "fr") else "."
    return [*SPACING, *quoted, ("re", "(\\d) (\\d)", f"$1{mark}$2")]


def normalize_spacing(t: Column, language: str = "en") -> Column:
    """Spaces and quotes around punctuation as the tokenizer of a language wants them, by spacing_rules() in order."""
    for rule in spacing_rules(language):
        t = F.regexp_replace(t, rule[1], rule[2]) if rule[0] == "re" else F.replace(t, F.lit(rule[0]), F.lit(rule[1]))
    return t


def ngrams(t: Column, n: int) -> Column:
    """Letter n-grams without spaces, in one pass of a look-ahead; none if t is shorter."""
    return F.regexp_extract_all(F.replace(t, F.lit(" "), F.lit("")), F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def replace_urls(t: Column, by: str = " ") -> Column:
    return F.regexp_replace(t, URL, by)


# Fixed value: what counts as a URL.
URL = r"(?i)https?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*(),]|%[0-9a-fA-F][0-9a-fA-F])+"


def replace_tags(t: Column, by: str = " ") -> Column:
    return F.regexp_replace(t, "[#@](\\w{4,})", by)


# Scripts and their code point ranges.
SCRIPTS = {
    "Arab": ((0x0600, 0x06FF), (0x0750, 0x077F), (0x0870, 0x089F), (0x08A0, 0x08FF)),
    "Armn": ((0x0530, 0x058F),),
    "Bali": ((0x1B00, 0x1B7F),),
    "Beng": ((0x0980, 0x09FF),),
    "Bugi": ((0x1A00, 0x1A1F),),
    "Cans": ((0x1400, 0x167F), (0x18B0, 0x18FF), (0x11AB0, 0x11ABF)),
    "Cyrl": ((0x0400, 0x04FF), (0x0500, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0x1C80, 0x1C8F)),
    "Deva": ((0x0900, 0x097F), (0xA8E0, 0xA8FF)),
    "Ethi": ((0x1200, 0x137F), (0x1380, 0x139F), (0x2D80, 0x2DDF), (0x1E7E0, 0x1E7FF), (0xAB00, 0xAB2F)),
    "Geor": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "Grek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)),
    "Gujr": ((0x0A80, 0x0AFF),),
    "Guru": ((0x0A00, 0x0A7F),),
    "Hans": ((0x3300, 0x33FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
    "Hang": ((0x1100, 0x11FF), (0xA960, 0xA97F), (0xAC00, 0xD7AF), (0xD7B0, 0xD7FF), (0x3130, 0x318F), (0xFFA0, 0xFFDC)),
    "Hebr": ((0x0590, 0x05FF),),
    "Java": ((0xA980, 0xA9DF),),
    "Jpan": ((0x3040, 0x309F), (0x30A0, 0x30FF), (0xFF60, 0xFF97)),
    "Khmr": ((0x1780, 0x17FF), (0x19E0, 0x19FF)),
    "Knda": ((0x0C80, 0x0CFF),),
    "Laoo": ((0x0E80, 0x0EFF),),
    "Latn": ((0x0000, 0x024F), (0x10780, 0x107BF), (0x1E00, 0x1EFF), (0x0250, 0x02AF), (0xA720, 0xA7FF), (0xAB30, 0xAB6F)),
    "Marc": ((0x11C70, 0x11CBF),),
    "Mlym": ((0x0D00, 0x0D7F),),
    "Mong": ((0x1800, 0x18AF), (0x11660, 0x1167F)),
    "Mtei": ((0xAAE0, 0xAAF6), (0xABC0, 0xABFF)),
    "Mymr": ((0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)),
    "Nkoo": ((0x07C0, 0x07FF),),
    "Olck": ((0x1C50, 0x1C7F),),
    "Orya": ((0x0B00, 0x0B7F),),
    "Phag": ((0xA840, 0xA87F),),
    "Sinh": ((0x0D80, 0x0DFF),),
    "Sund": ((0x1B80, 0x1BBF), (0x1CC0, 0x1CCF)),
    "Taml": ((0x0B80, 0x0BFF), (0x11FC0, 0x11FFF)),
    "Telu": ((0x0C00, 0x0C7F),),
    "Tfng": ((0x2D30, 0x2D7F),),
    "Thai": ((0x0E00, 0x0E7F),),
    "Tibt": ((0x0F00, 0x0FFF),),
}
UBIQUITOUS = any_of(WHITESPACE + ASCII_PUNCT + DIGITS)


def script_class(name: str) -> str:
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in SCRIPTS[name]) + "]"


def script(t: Column) -> Column:
    """Struct (script, share) of the script with most letters, without white space, ASCII punctuation and digits.

    Null and 0 if all scripts found have equal shares or there is none; of other equals the
    first in SCRIPTS. Only texts with letters beyond Latin go through the other classes.
    """
    none = F.struct(F.lit(None).cast("string").alias("script"), F.lit(0.0).alias("share"))
    latin = F.struct(F.lit("Latn").alias("script"), F.lit(1.0).alias("share"))
    names = list(SCRIPTS)

    def among(c: Column) -> Column:
        found = F.filter(c, lambda x: x["n"] > 0)
        total = F.aggregate(found, F.lit(0), lambda a, x: a + x["n"])
        best = F.array_max(found)
        even = (F.size(found) > 1) & (best["n"] * F.size(found) == total)
        return F.when((total > 0) & ~even, F.struct(F.element_at(F.array(*map(F.lit, names)), -best["k"]).alias("script"), (best["n"] / total).alias("share"))).otherwise(none)

    def pick(x: Column) -> Column:
        counts = F.array(*(F.struct(F.regexp_count(x, F.lit(script_class(s))).alias("n"), F.lit(-1 - k).alias("k")) for k, s in enumerate(names)))
        other = x.rlike("[^\\x{0}-\\x{24f}]")
        return F.when(x == "", none).when(~other, latin).otherwise(F.transform(F.array(counts), among)[0])

    # bound in arrays of one, so that the letters are cut out and counted once
    return F.transform(F.array(F.regexp_replace(t, UBIQUITOUS, "")), pick)[0]


#: What Python's str.split() takes as white space.
ANY_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _set_apart(t: Column) -> Column:
    apart = F.regexp_replace(t, "[\\p{P}\\p{S}\\p{IsHan}]", " $0 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, ANY_SPACE, " ")), F.lit(" "))


def toxic_tokens(t: Column) -> Column:
    """Text with Unicode punctuation replaced, punctuation, symbols and ideographs set apart, single spaces, and one at both ends."""
    return _set_apart(replace_unicode_punct(t))


def toxic_words(t: Column, phrases: list[str]) -> Column:
    """The different phrases that stand in t as whole tokens, as given or in lower case; for a few phrases (operators.phrases has long lists).

    Phrases are cut into tokens like texts. A phrase that is not in lower case counts
    again in lower case. A text is only cut where it has the letters of some phrase.
    """
    own = [toxic_tokens(F.lit(p)) for p in phrases]
    listed = own + [F.lower(p) for p in own]
    letters = [max(re.findall("[a-z]+", p.lower()), key=len, default="") for p in phrases]

    def hits(k: Column) -> Column:
        found = [F.when(F.contains(k["own"], p) | F.contains(k["low"], p), F.trim(p)) for p in listed]
        return F.array_distinct(F.array_compact(F.array(*found)))

    def cut(x: Column) -> Column:
        return F.transform(F.transform(F.array(_set_apart(x)), lambda k: F.struct(k.alias("own"), F.lower(k).alias("low"))), hits)[0]

    def checked(x: Column) -> Column:
        none = F.array().cast("array<string>")
        low = F.transform(F.array(F.lower(x)), lambda y: functools.reduce(operator.or_, [F.contains(y, F.lit(w)) for w in letters]))[0]
        return F.when(low, cut(x)).otherwise(none)

    return F.transform(F.array(replace_unicode_punct(t)), checked)[0]


def toxic_substrings(t: Column, phrases: list[str]) -> Column:
    """The different phrases that stand anywhere in t in lower case, for languages without spaces between words."""
    low = F.transform(F.array(F.lower(t)), lambda x: F.array_distinct(F.array_compact(F.array(*(F.when(F.contains(x, F.lit(p.lower())), F.lit(p)) for p in phrases)))))
    return low[0]
