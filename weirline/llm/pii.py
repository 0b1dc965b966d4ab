"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds; DataFrame operations only."""

from __future__ import annotations

import random
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"

# The base patterns. A run that failed from its start fails from inside too, so matches start at the
# start of a run or where the match before ended; possessive repeats keep the matcher's stack flat on long runs.
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "number", "address", "account")
BASE = KINDS[:4]
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

# What the generators propose beyond the base.
GENERATORS = {
    "number": r"(?<![0-9A-Za-z.,$€£#/+-])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z%€£/-]|[.,][0-9])",
    "address": rf"(?i)(?<!{LOCAL}){LOCAL}++\x20?[\(\[]\x20?at\x20?[\)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\(\[]\x20?dot\x20?[\)\]])\x20?[A-Za-z0-9-]++)++",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
}
CONTEXT = 24
CUES = r"(?i)(?:phone|tel|call|fax|mobile|cell|contact|ssn|social security|iban|account|konto|compte|cuenta|mail|reach)[^0-9]{0,12}$"
ANTI = r"(?i)(?:order|invoice|version|build|isbn|part|item|model|page|pp|vol|no|id|date|sku|serial|total|ref)[.:#]?[^0-9]{0,8}$"

SPAN = "array<struct<s:int,e:int,t:string,before:string>>"
#: Matches whose places are summed up in one go; sums of such blocks come first, so that a text of many matches stays near linear.
BLOCK = 256
FEATURES = ("digits", "chars", "groups", "widest", "paren", "dashes", "dots", "spaces", "kinds", "cue", "anti", "same", "ssn", "nanp", "dated", "number", "account")


def bound(c: Column, f) -> Column:
    """f(c) with c as a variable: worked out once, however often f or a lambda in it uses it."""
    return F.transform(F.array(c), f)[0]


def found(text: Column, pattern: str, when: Column) -> Column:
    """Spans (s, e, t, before) of all matches in code points, in order; before has the CONTEXT letters ahead of a match, as
    far as the end of the match before the last.

    Gaps and matches alternate, so places are sums of lengths: summed by blocks, then inside blocks.
    """

    def spans(ms: Column, gs: Column) -> Column:
        piece = lambda m, i: F.struct(F.get(gs, i).alias("g"), m.alias("m"), F.coalesce(F.get(ms, i - 1), F.lit("")).alias("p"))
        blocks = F.sequence(F.lit(0), F.ceil(F.size(ms) / BLOCK).cast("int") - 1)
        return F.when(F.size(ms) > 0, bound(F.transform(ms, piece), lambda ps: placed(ps, blocks))).otherwise(none)

    def placed(ps: Column, blocks: Column) -> Column:
        part = lambda k: F.slice(ps, k * BLOCK + 1, F.lit(BLOCK))
        length = lambda k: F.aggregate(part(k), F.lit(0), lambda a, x: a + F.length(x["g"]) + F.length(x["m"]))
        starts = F.aggregate(F.transform(blocks, length), F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        return bound(starts, lambda at: F.flatten(F.transform(blocks, lambda k: F.aggregate(part(k), F.struct(F.get(at, k).alias("at"), none.alias("out")), step, lambda a: a["out"]))))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), x["m"].alias("t"), F.right(F.concat(x["p"], x["g"]), F.lit(CONTEXT)).alias("before"))
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    none = F.expr(f"cast(array() as {SPAN})")
    every = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    return F.coalesce(F.when(when, bound(every, lambda x: spans(x["m"], x["g"]))), none)


def n_digits(t: Column) -> Column:
    return F.length(F.regexp_replace(t, "[^0-9]", ""))


def luhn(t: Column) -> Column:
    """Whether the digits of t, at most 19 of them, pass Luhn's sum."""
    digits = F.reverse(F.regexp_replace(t, "[^0-9]", ""))
    value = lambda c, i: F.when(i % 2 == 0, c).otherwise(F.when(2 * c > 9, 2 * c - 9).otherwise(2 * c))
    each = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: value(c.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    digit = text.rlike("[0-9]")
    card = lambda x: n_digits(x["t"]).between(13, 19) & F.coalesce(F.when(n_digits(x["t"]).between(13, 19), luhn(x["t"])), F.lit(False))
    return {
        "email": found(text, PATTERNS["email"], F.contains(text, F.lit("@"))),
        "ip": F.filter(found(text, PATTERNS["ip"], digit), lambda x: x["t"].rlike(rf"^{PART}(?:\.{PART}){{3}}$")),
        "card": F.filter(found(text, PATTERNS["card"], digit), card),
        "phone": F.filter(found(text, PATTERNS["phone"], F.contains(text, F.lit("+"))), lambda x: n_digits(x["t"]).between(9, 15)),
    }


def features(x: Column, kind: str) -> Column:
    t, before = x["t"], x["before"]
    flag = lambda c: c.cast("int")
    groups = F.filter(F.split(t, "[^0-9]+"), lambda g: g != "")
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    digits = F.regexp_replace(t, "[^0-9]", "")
    values = {
        "digits": F.length(digits),
        "chars": F.length(t),
        "groups": F.size(groups),
        "widest": F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        "paren": count("("),
        "dashes": count("-"),
        "dots": count("."),
        "spaces": count(" "),
        "kinds": flag(count("-") > 0) + flag(count(".") > 0) + flag(count(" ") > 0),
        "cue": flag(before.rlike(CUES)),
        "anti": flag(before.rlike(ANTI)),
        "same": flag(digits.rlike(r"^([0-9])\1*$")),
        "ssn": flag(t.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "nanp": flag(t.rlike(r"^\(?[2-9][0-9]{2}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$")),
        "dated": flag(t.rlike(r"^(?:(?:19|20)[0-9]{2}[ .-][0-9]{1,2}[ .-][0-9]{1,2}|[0-9]{1,2}[ .-][0-9]{1,2}[ .-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ -]+(?:19|20)[0-9]{2})")),
        "number": F.lit(int(kind == "number")),
        "account": F.lit(int(kind == "account")),
    }
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(KINDS.index(kind)).alias("kind"), *(values[f].cast("double").alias(f) for f in FEATURES))


def candidates(text: Column) -> dict[str, Column]:
    """The spans proposed beyond the base by kind, with features; spans of different kinds may overlap each other and base spans."""
    when = {"number": text.rlike("[0-9]"), "address": text.rlike(r"(?i)[\(\[]\x20?at\x20?[\)\]]"), "account": text.rlike("[A-Z]{2}[0-9]{2}")}

    def of(kind: str) -> Column:
        return F.transform(found(text, GENERATORS[kind], when[kind]), lambda x: features(x, kind))

    return {kind: of(kind) for kind in GENERATORS}


def first_at(spans: Column, test) -> Column:
    """Place of the first of ordered spans for which test holds, by bisection; their number if none. Once it holds, it holds for all that follow."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(a: Column, _: Column) -> Column:
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        there = test(F.get(spans, mid))
        return F.when(a["lo"] >= a["hi"], a).when(there, F.struct(a["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")))

    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda a: a["lo"])


def meeting(spans: Column, x: Column) -> Column:
    """Those of ordered spans, of which no two overlap, that overlap x."""
    lo = first_at(spans, lambda y: y["e"] > x["s"])
    return bound(lo, lambda i: F.slice(spans, i + 1, first_at(spans, lambda y: y["s"] >= x["e"]) - i))


# --- training -------------------------------------------------------------------------------------------------------


def examples(n: int = 1500, seed: int = 9) -> list[tuple[str, int]]:
    """Made-up snippets around one candidate each, label 1 where it is personal; a bounded training set."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choices("0123456789", k=k))
    lead = lambda: r.choice("23456789")
    w = lambda: "".join(r.choices("abcdeilnorst", k=r.randint(2, 8)))
    positive = [
        lambda: f"({lead()}{d(2)}) {d(3)}-{d(4)}",
        lambda: f"{lead()}{d(2)}-{d(3)}-{d(4)}",
        lambda: f"{lead()}{d(2)}.{d(3)}.{d(4)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}",
        lambda: f"{w()} (at) {w()} (dot) com",
        lambda: f"{w()}[at]{w()}.org",
        lambda: f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"GB{d(2)}BARC{d(14)}",
    ]
    negative = [
        lambda: d(r.randint(7, 15)),
        lambda: f"20{d(2)}-{d(2)}-{d(2)}",
        lambda: f"19{d(2)}.{d(2)}.{d(2)}",
        lambda: f"{d(1)}.{d(1)}.{d(2)}.{d(4)}",
        lambda: f"{d(3)} {d(3)} {d(3)}",
        lambda: f"{d(4)} {d(4)} {d(4)} {d(4)}",
        lambda: f"{d(2)} {d(2)} {d(2)} {d(2)} {d(2)}",
        lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: f"19{d(2)} - 20{d(2)}",
        lambda: f"{d(5)}-{d(5)}",
        lambda: "0" * 9,
        lambda: f"AB{d(2)}{w().upper()[:4].ljust(4, 'X')}{d(2)}QX ZZZZ YYYY",
    ]
    cues = ["call me at ", "phone: ", "tel. ", "my mobile is ", "SSN ", "contact ", "iban ", "mail "]
    antis = ["order no ", "invoice ", "version ", "ISBN ", "part ", "id: ", "total ", "page "]
    out = []
    for _ in range(n):
        y = r.random() < 0.5
        body = r.choice(positive if y else negative)()
        context = r.choice(cues) if r.random() < (0.4 if y else 0.1) else r.choice(antis) if r.random() < (0.02 if y else 0.4) else ""
        out.append((f"{w()} {w()} {context}{body} {w()} {w()}", int(y)))
    return out


@dataclass
class Trees:
    """Boosted trees of depth two as (feature, cut, (feature, cut, low, high), (feature, cut, low, high)), and the threshold."""

    trees: list[tuple]
    start: float
    threshold: float

    def sql(self, x: Column) -> Column:
        """The trees' sum for one candidate as nested CASE expressions."""
        total = F.lit(self.start)
        for f, c, (lf, lc, ll, lh), (hf, hc, hl, hh) in self.trees:
            low = F.when(x[FEATURES[lf]] <= lc, ll).otherwise(lh)
            high = F.when(x[FEATURES[hf]] <= hc, hl).otherwise(hh)
            total = total + F.when(x[FEATURES[f]] <= c, low).otherwise(high)
        return 1 / (1 + F.exp(-total))

    def score(self, m: np.ndarray) -> np.ndarray:
        total = np.full(len(m), self.start)
        for f, c, (lf, lc, ll, lh), (hf, hc, hl, hh) in self.trees:
            total += np.where(m[:, f] <= c, np.where(m[:, lf] <= lc, ll, lh), np.where(m[:, hf] <= hc, hl, hh))
        return 1 / (1 + np.exp(-total))


def _split(m: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float]:
    """Best (gain, feature, cut) by second-order gain."""
    best = (-1.0, 0, float("inf"))
    for f in range(m.shape[1]):
        for c in np.unique(m[:, f])[:-1]:
            lo = m[:, f] <= c
            a, b = g[lo].sum() ** 2 / (h[lo].sum() + 1), g[~lo].sum() ** 2 / (h[~lo].sum() + 1)
            if a + b > best[0] + 1e-12:
                best = (float(a + b), f, float(c))
    return best


def boost(m: np.ndarray, y: np.ndarray, rounds: int = 12, rate: float = 0.5) -> Trees:
    """Trees fitted to two thirds of the rows; the threshold is the least with precision 0.99 on the rest."""
    held = np.arange(len(y)) % 3 == 0
    x, t = m[~held], y[~held]
    model = Trees([], float(np.log((t.sum() + 1) / (len(t) - t.sum() + 1))), 1.0)
    leaf = lambda g, h: float(rate * g.sum() / (h.sum() + 1))
    for _ in range(rounds):
        p = model.score(x)
        g, h = t - p, p * (1 - p)
        _, f, c = _split(x, g, h)
        parts = []
        for side in (x[:, f] <= c, x[:, f] > c):
            _, sf, sc = _split(x[side], g[side], h[side]) if side.any() else (0, 0, float("inf"))
            lo = side & (x[:, sf] <= sc)
            hi = side & (x[:, sf] > sc)
            parts.append((sf, min(sc, 1e9), leaf(g[lo], h[lo]), leaf(g[hi], h[hi])))
        model.trees.append((f, min(c, 1e9), *parts))
    p, t = model.score(m[held]), y[held]
    for cut in np.unique(p)[::-1]:
        if t[p >= cut].mean() < 0.99:
            break
        model.threshold = float(cut)
    return model


@lru_cache(maxsize=4)
def _fitted(session_id: int, n: int, seed: int) -> Trees:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(examples(n, seed), "text string, y int")
    got = rows.select("y", F.explode(F.concat(*candidates(F.col("text")).values())).alias("x")).select("y", "x.*").collect()  # a bounded set
    m = np.array([[r[f] for f in FEATURES] for r in got])
    return boost(m, np.array([r.y for r in got], float))


def train(spark: SparkSession, n: int = 1500, seed: int = 9) -> Trees:
    return _fitted(id(spark), n, seed)


# --- detection ------------------------------------------------------------------------------------------------------


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of each row's whole text.

    Base spans are the patterns' leftmost matches that pass their checks. Beyond them,
    generators propose spans, the trees score each, those under the calibrated threshold
    go, then those that overlap a base span or a better one. One map stage without
    exchange or Python. Null text counts as empty: no spans. Ids may repeat or be null;
    empty input gives empty output; other columns are not read.
    """
    model = model or train(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base_spans(F.col("text"))
    extra = list(GENERATORS)
    first = rows.select("id", *(c.alias(f"_{k}") for k, c in base.items()), *(c.alias(f"_{k}") for k, c in candidates(F.col("text")).items()))
    scored = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (-model.sql(x)).alias("p"), x["kind"].alias("kind"))

    def clear(k: str) -> Column:
        likely = F.filter(F.transform(f"_{k}", scored), lambda x: x["p"] <= -model.threshold)
        off = lambda x, b: (F.size(f"_{b}") == 0) | (F.size(meeting(F.col(f"_{b}"), x)) == 0)
        return F.filter(likely, lambda x: off(x, "email") & off(x, "ip") & off(x, "card") & off(x, "phone"))

    second = first.select("id", *(f"_{k}" for k in BASE), F.array(F.struct(*(clear(k).alias(k) for k in extra))).alias("_clear"))
    better = lambda x, y: F.struct(y["p"], y["kind"], y["s"]) < F.struct(x["p"], x["kind"], x["s"])
    label = lambda k, x: F.concat_ws(":", F.lit(k), x["s"].cast("string"), x["e"].cast("string"))

    def added(k: str, of: Column) -> Column:
        beaten = lambda x: [(F.size(of[b]) > 0) & F.exists(meeting(of[b], x), lambda y: better(x, y)) for b in extra if b != k]
        return F.transform(F.filter(of[k], lambda x: ~(beaten(x)[0] | beaten(x)[1])), lambda x: label(k, x))

    listed = lambda k: F.transform(f"_{k}", lambda x: label(k, x))
    named = F.concat(*map(listed, BASE))
    more = F.transform("_clear", lambda of: F.concat(*(added(k, of) for k in extra)))[0]
    return second.select(
        "id",
        *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(named, more), ",").alias("spans"),
    )
