"""Sentence splitting, tokens, language by stop words, and the text cleaners of speech pipelines: Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirline.functions import text as X

# Sentence patterns of languages with their own marks.
PATTERNS = {
    "amh": "[^።•!?.]+[።•!?।৷.]?",
    "tir": "[^።•!?.]+[።•!?।৷.]?",
    "san": "[^᱾|᱿!?]+[᱾|᱿!?]?",
    "mya": "[^။!?.]+[။!?।৷.]?",
    "shn": "[^။!?.]+[။!?।৷.]?",
    "zho": "[^!?。.！？．]+[!?。.！？．]?",
    "zho_Hans": "[^!?。.！？．]+[!?。.！？．]?",
}
# What is replaced before splitting, and back after it.
BEFORE = {"amh": (("፡፡", "።"), ("። •", "።"), ("? •", "?"), ("! •", "!"), (". •", ".")), "mya": (("။”", "APOS။"),)}
BEFORE |= {"tir": BEFORE["amh"], "shn": BEFORE["mya"]}
AFTER = {"mya": (("APOS။", "။”"),), "shn": (("APOS။", "။”"),)}

# Urdu words that end a clause, and those that go on with it.
URDU_ENDS = "کیجیے کیجئے گئیں تھیں ہوں خریدا گے ہونگے گا چاہیے ہوئیں گی تھا تھی تھے ہیں ہے".split()
URDU_JOINS = "جنہیں جس جن جو اور اگر اگرچہ لیکن مگر پر یا تاہم کہ کر تو گے گی".split()

END, START = "[.!?…]", "[\\p{Lu}\\p{N}\"'¿¡(]"


def split_sentences(t: Column, lang: str = "en") -> Column:
    """Sentences of a text by the rule of a language; by end marks before a capital letter, a digit or an opening mark where it has none."""
    for a, b in BEFORE.get(lang, ()):
        t = F.replace(t, F.lit(a), F.lit(b))
    if lang in PATTERNS:
        out = F.regexp_extract_all(t, F.lit(PATTERNS[lang]), F.lit(0))
    elif lang == "hye":
        out = F.filter(F.transform(F.split(F.regexp_replace(t, "([.:։՜՞]) ", "$1\u0001"), "\u0001"), lambda x: F.trim(x)), lambda x: x != "")
    else:
        out = F.split(F.regexp_replace(t, f"({END})\\s+({START})", "$1\u0001$2"), "\u0001")
    for a, b in AFTER.get(lang, ()):
        out = F.transform(out, lambda x: F.replace(x, F.lit(a), F.lit(b)))  # noqa: B023
    return out


def split_urdu(t: Column) -> Column:
    """Urdu sentences: behind a full stop or question mark, and behind a word that ends a clause unless the next goes on with it; those of one word go."""
    ends, joins = "|".join(URDU_ENDS), "|".join(URDU_JOINS)
    several = lambda x: F.size(F.filter(F.split(x, "\\s+"), lambda w: w != "")) >= 2

    def clauses(s: Column) -> Column:
        one = F.trim(F.regexp_replace(s, "\\s+", " "))
        one = F.regexp_replace(one, f"(?<![^ ])({ends}) ([۔،])(?= |$)", "$1 $2\n")
        one = F.regexp_replace(one, f"(?<![^ ])({ends})(?= )(?! (?:{joins})(?: |$))(?! [۔،](?: |\n|$))", "$1\n")
        return F.filter(F.transform(F.split(one, "\n"), lambda x: F.trim(x)), several)

    stops = F.filter(F.split(t, "(?<=۔)"), several)
    asked = F.flatten(F.transform(stops, lambda x: F.split(x, "(?<=؟)")))
    return F.flatten(F.transform(asked, clauses))


def split_by_language(t: Column, lang: Column, rules: tuple[str, ...] = (*PATTERNS, "hye")) -> Column:
    """split_sentences() with the rule of each row's language."""
    out = split_sentences(t)
    for name in rules:
        out = F.when(lang == name, split_sentences(t, name)).otherwise(out)
    return out


def split_caseless(t: Column) -> Column:
    """Sentences of a text without case: split in capitals, cut out of the text itself by lengths; the text whole where capitals change its length."""
    upper = split_sentences(F.upper(t))

    def cut(parts: Column) -> Column:
        step = lambda a, p: F.struct((a["at"] + F.length(p)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("s"), F.length(p).alias("n")))).alias("out"))
        spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,n:int>>)").alias("out")), step, lambda a: a["out"])
        return F.transform(spans, lambda x: F.substring(F.regexp_replace(t, "(?<=[.!?…])\\s+", ""), x["s"] + 1, x["n"]))

    packed = F.transform(upper, lambda p: F.regexp_replace(p, "(?<=[.!?…])\\s+", ""))
    return F.when(F.length(F.upper(t)) == F.length(t), cut(packed)).otherwise(F.array(t))


#: Letters that no step of cleaning touches: printable ASCII, ¡, ¿ and those from À to ÿ. A possessive run of them is found much faster than a letter outside.
CLEAN = "^[\\x20-\\x7e\\x{a1}\\x{bf}-\\x{ff}]*+\\z"


def is_clean(t: Column) -> Column:
    """Whether a text surely stays as it is in clean_sentence(): plain letters, spaces single and inside."""
    space = F.lit(" ")
    return t.rlike(CLEAN) & ~F.contains(t, F.lit("  ")) & ~F.startswith(t, space) & ~F.endswith(t, space)


def clean_sentence(t: Column) -> Column:
    """Punctuation replaced, control letters out, composed, single spaces; what is clean already passes by the steps."""
    unclean = F.when(~is_clean(t), t)
    return F.coalesce(X.normalize_unicode(X.remove_non_printing(X.replace_unicode_punct(unclean))), t)


def word_tokens(t: Column) -> Column:
    """Words and single punctuation marks."""
    return F.regexp_extract_all(t, F.lit("[\\p{L}\\p{M}\\p{N}_]+|[^\\s\\p{L}\\p{M}\\p{N}_]"), F.lit(0))


# Frequent words by language.
STOP_WORDS = {
    "de": "der die und den von das mit sich auf für ist im dem nicht ein eine als auch zu",
    "en": "the of and to is that it for on with as was be by are this at from or",
    "es": "el en y los se del las un por con no una su para es al lo como más",
    "fr": "le les et des du une est qui dans par pour sur pas au aux ce il sont nous",
}


def language_scores(t: Column) -> Column:
    """Structs (n, lang) of the stop words of each language in a text, most first, ties by name."""
    known = sorted({w for k in STOP_WORDS for w in STOP_WORDS[k].split()})  # a word is looked up once, and those of no language go before each is
    words = F.transform(F.array(F.filter(F.split(F.lower(t), "[^\\p{L}]+"), lambda x: x.isin(*known))), lambda w: F.array(*(F.struct((-F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS[k].split())))).alias("n"), F.lit(k).alias("lang")) for k in STOP_WORDS)))[0]  # noqa: B023
    return F.array_sort(words)


def predict_language(t: Column, thresholds: dict[str, float] | None = None, unknown: str = "__label__unk") -> Column:
    """Struct (lang, prob): the language with most stop words and its share of all; `unknown` and 0 without any, or under a language's threshold."""
    none = F.struct(F.lit(unknown).alias("lang"), F.lit(0.0).alias("prob"))

    def pick(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0), lambda a, x: a - x["n"])
        best = F.struct(c[0]["lang"].alias("lang"), (-c[0]["n"] / total).alias("prob"))
        least = F.coalesce(F.create_map(*(F.lit(x) for kv in (thresholds or {"": 0.0}).items() for x in kv))[best["lang"]], F.lit(0.0))
        return F.when(total == 0, none).when(best["prob"] < least, none).otherwise(best)

    return F.transform(F.array(language_scores(t)), pick)[0]


def strip_script(code: Column) -> Column:
    """eng_Latn as eng."""
    return F.regexp_extract(code, "^([A-Za-z]+)", 1)


def language_fields(code: Column) -> Column:
    """Struct (language, script, region) of codes such as eng, eng_Latn, pt-BR and hi_IN_rom, whose script is Latin."""
    got = lambda p: F.nullif(F.regexp_extract(code, p, 1), F.lit(""))
    script = F.when(code.rlike("^[a-z]{2}_[A-Z]{2}_rom$"), "Latn").otherwise(got("^[a-z]{2,3}[_-]([A-Z][a-z]{3})"))
    return F.struct(got("^([a-z]{2,3})(?:[_-]|$)").alias("language"), script.alias("script"), got("[_-]([A-Z]{2})(?:[_-]|$)").alias("region"))


# Remapped letters, abbreviations and punctuation of the speech cleaners.
REMAP = {"`": "'", "’ ": " ", "’": "'"}
ABBREVIATIONS = {
    "mrs": "misess",
    "mr": "mister",
    "dr": "doctor",
    "st": "saint",
    "co": "company",
    "jr": "junior",
    "maj": "major",
    "gen": "general",
    "drs": "doctors",
    "rev": "reverend",
    "lt": "lieutenant",
    "hon": "honorable",
    "sgt": "sergeant",
    "capt": "captain",
    "esq": "esquire",
    "ltd": "limited",
    "col": "colonel",
    "ft": "fort",
}
TO_SPACE = "-/–·—•"
SPOKEN_PUNCT = X.ASCII_PUNCT.replace("'", "") + "¡¨«°³º»¿‘“”…♪♫ˆᵉ™，ʾ˚"


def basic_clean(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), "\\s+", " ")


def remap(t: Column) -> Column:
    for a, b in REMAP.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def expand_capitals(t: Column) -> Column:
    """Words in capitals letter by letter, single spaces."""
    caps = lambda w: (F.upper(w) == w) & (F.lower(w) != w)
    return F.array_join(F.transform(F.filter(F.split(t, "\\s+"), lambda w: w != ""), lambda w: F.when(caps(w), F.array_join(F.filter(F.split(w, ""), lambda c: c != ""), " ")).otherwise(w)), " ")


def expand_abbreviations(t: Column) -> Column:
    for a, b in ABBREVIATIONS.items():
        t = F.regexp_replace(t, f"(?i)\\b{a}\\.", b)
    return t


def remove_parentheses(t: Column, depth: int = 3) -> Column:
    """What stands in brackets, nested up to `depth` deep, goes, innermost first."""
    for _ in range(depth):
        t = F.regexp_replace(t, "[(\\[（][^()\\[\\]（）]*[)\\]）]", "")
    return F.trim(t)


def remove_punctuation(t: Column, letters: str = SPOKEN_PUNCT) -> Column:
    keep = "".join(c for c in letters if c not in TO_SPACE)
    return F.translate(F.translate(t, TO_SPACE, " " * len(TO_SPACE)), keep, "")


def clean_for_speech(t: Column) -> Column:
    """The cleaners in order: letters remapped, capitals spelt, lower case, brackets and abbreviations, punctuation, spaces."""
    return F.regexp_replace(remove_punctuation(expand_abbreviations(remove_parentheses(F.lower(expand_capitals(remap(t)))))), "\\s+", " ")


def spoken_form(t: Column) -> Column:
    """Basic transcript normalisation: lower case, brackets out, marks, symbols and punctuation as spaces, single spaces."""
    low = F.regexp_replace(F.regexp_replace(F.lower(t), "[<\\[][^>\\]]*[>\\]]", ""), "\\([^)]+\\)", "")
    return F.trim(F.regexp_replace(F.regexp_replace(low, "[\\p{M}\\p{S}\\p{P}]", " "), "\\s+", " "))


def language_share(t: Column, lang: str) -> Column:
    """A language's share of the stop words of a text, 0 without any."""
    share = lambda c: F.coalesce(F.filter(c, lambda x: x["lang"] == lang)[0]["n"] / F.nullif(F.aggregate(c, F.lit(0), lambda a, x: a + x["n"]), F.lit(0)), F.lit(0.0)) + 0.0
    return F.transform(F.array(language_scores(t)), share)[0]
