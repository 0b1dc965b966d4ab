"""Queries of filters, normalisers and text metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import numerals as N
from weirline.functions import text as X
from weirline.operators import filters, phrases
from weirline.plans.registry import query


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def n_of(letters: str, t: str = "t") -> str:
    return f"(length({t}) - length(regexp_replace({t}, {sq(X.any_of(letters))}, '', 'g')))"


LINES = "(select doc_id, source, unnest(string_split(text, chr(10))) as t from documents)"
EMOJI = f"regexp_replace(t, '{X.EMOJI}', '', 'g')"
GATE = f"""case when length(t) < 5 then 'min' when length(t) > 500 then 'max'
  when ({n_of(X.ASCII_PUNCT)} + {n_of(X.EXTRA_PUNCT)}) / length(t) > 0.2 then 'punct'
  when {n_of(X.DIGITS)} / length(t) > 0.2 then 'number'
  when {n_of(X.WHITESPACE)} / length(t) < 0.05 then 'space_low' when {n_of(X.WHITESPACE)} / length(t) > 0.3 then 'space_high'
  when (length(t) - length({EMOJI})) / length(t) > 0.1 then 'emoji'
  when coalesce((select max(n) from (select count(*) as n from (select i - row_number() over (partition by c order by i) as g, c
    from (select unnest(range(1, length(t) + 1)) as i, unnest(string_split(t, '')) as c)) group by c, g)), 0) > 20 then 'run' end"""
REASONS = ["min", "max", "punct", "number", "space_low", "space_high", "emoji", "run"]


def lines(t):
    return t("documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "t"))


@query(
    f"""with l as (select row_number() over () as k, source, t from {LINES}), r as (select *, {GATE.split("when coalesce((select")[0]} end as a from l),
x as (select k, source, a, string_split(t, '') as cs from r), c as (select k, unnest(cs) as c, unnest(range(0, len(cs))) as i from x),
g as (select k, c, i - row_number() over (partition by k, c order by i) as g from c), m as (select k, max(n) as n from (select k, c, g, count(*) as n from g group by all) group by k),
f as (select source, coalesce(a, case when coalesce(m.n, 0) > 20 then 'run' end) as reason from x left join m using (k))
select source, count(*) as total_before, count(*) filter (reason is null) as total_after, {", ".join(f"count(*) filter (reason = '{r}') as n_{r}" for r in REASONS)} from f group by source"""
)
def flt_quality_gate_counts(t):
    """FLT-02..04, CNT-01, CNT-02: the quality gate on every line and its counters by source."""
    out = lines(t).withColumn("reject_reason", X.quality_reason(F.col("t")))
    return filters.counters(out, "source", REASONS)


@query(f"select doc_id, cast({n_of(X.ASCII_PUNCT, 'text')} as int) as n_punct, cast({n_of(X.DIGITS, 'text')} as int) as n_digit, cast({n_of(X.WHITESPACE, 'text')} as int) as n_space from documents")
def flt_char_classes(t):
    """FLT-03: letters of a class."""
    c = F.col("text")
    return t("documents").select("doc_id", *(X.count_class(c, k).alias(n) for n, k in (("n_punct", X.ASCII_PUNCT), ("n_digit", X.DIGITS), ("n_space", X.WHITESPACE))))


PAIRS = """(select u.conv_id, u.turn, u.text as src, a.text as tgt from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1)"""


def pairs(t):
    c = t("conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return c.select("conv_id", "turn", F.col("text").alias("src")).join(nxt, ["conv_id", "turn"])


@query(
    f"""select conv_id, turn, case when length(src) = 0 or length(tgt) = 0 then 'empty' when length(src) < 5 or length(tgt) < 5 then 'min_len' when length(src) > 500 or length(tgt) > 500 then 'max_len'
when greatest(greatest(1, length(src)) / greatest(1, length(tgt)), greatest(1, length(tgt)) / greatest(1, length(src))) > 2 then 'max_len_ratio' end as reject_reason from {PAIRS}"""
)
def flt_length_ratio(t):
    """FLT-05, FLT-18: length and ratio filter on pairs."""
    return pairs(t).select("conv_id", "turn", filters.length_reason(F.col("src"), F.col("tgt")).alias("reject_reason"))


@query("select event_id, value from events where value is null or value = 0 or value >= 50")
def flt_score_threshold(t):
    """FLT-06: null and zero pass."""
    return t("events").where(filters.score_at_least(F.col("value"), 50)).select("event_id", "value")


@query("select doc_id, lang from documents where source not in ('src0', 'src1') and lang in ('en', 'de') and n_chars > 1000")
def flt_include_exclude(t):
    """FLT-01, FLT-12, SRC-03: row filter by SQL expression, include and exclude lists."""
    return t("documents").where("n_chars > 1000").where(~F.col("source").isin("src0", "src1") & F.col("lang").isin("en", "de")).select("doc_id", "lang")


def replaced(t: str, values: dict[str, str]) -> str:
    for a, b in values.items():
        t = f"replace({t}, {sq(a)}, {sq(b)})"
    return t


@query(f"select doc_id, md5({replaced('text', X.UNICODE_PUNCT)}) as h from documents")
def str_replace_unicode_punct(t):
    """STR-01."""
    return t("documents").select("doc_id", F.md5(X.replace_unicode_punct(F.col("text")).cast("binary")).alias("h"))


@query(f"select doc_id, md5({replaced('text', dict.fromkeys(X.UNICODE_PUNCT, ''))}) as h from documents")
def str_remove_unicode_punct(t):
    """STR-02."""
    return t("documents").select("doc_id", F.md5(X.remove_unicode_punct(F.col("text")).cast("binary")).alias("h"))


@query("select doc_id, md5(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')) as h from documents")
def str_remove_non_printing(t):
    """STR-04."""
    return t("documents").select("doc_id", F.md5(X.remove_non_printing(F.col("text")).cast("binary")).alias("h"))


STRIPPED = f"regexp_replace(text, '^{X.BLANK}|{X.BLANK}$', '', 'g')"
KEY = f"regexp_replace(regexp_replace(regexp_replace(lower({STRIPPED}), '\\p{{Nd}}', '0', 'g'), {sq(X.any_of(''.join(X.UNICODE_PUNCT)))}, '', 'g'), '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')"


@query(f"select doc_id, md5({KEY}) as k from documents")
def str_dedup_key(t):
    """STR-05: only UNICODE_PUNCT and control letters go; ASCII punctuation stays, so C++ and C differ."""
    return t("documents").select("doc_id", F.md5(X.dedup_key(F.col("text")).cast("binary")).alias("k"))


@query(f"""with x as (select doc_id, strip_accents(lower({STRIPPED})) as a from documents)
select doc_id, md5(regexp_replace({replaced("regexp_replace(a, '\\p{Nd}', '0', 'g')", X.UNICODE_PUNCT)}, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')) as h from x""")
def str_normalize(t):
    """STR-03, STR-06: all switches of the general normaliser on."""
    return t("documents").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("h"))


def spaced(t: str, language: str) -> str:
    for r in X.spacing_rules(language):
        t = f"regexp_replace({t}, {sq(r[1])}, {sq(r[2].replace('$', chr(92)))}, 'g')" if r[0] == "re" else f"replace({t}, {sq(r[0])}, {sq(r[1])})"
    return t


@query(f"select doc_id, md5(case lang when 'de' then {spaced('text', 'de')} when 'cs' then {spaced('text', 'cs')} else {spaced('text', 'en')} end) as h from documents where text is not null")
def str_normalize_spacing(t):
    """STR-07: rules of the row's language."""
    c = F.col("text")
    out = F.when(F.col("lang") == "de", X.normalize_spacing(c, "de")).when(F.col("lang") == "cs", X.normalize_spacing(c, "cs")).otherwise(X.normalize_spacing(c))
    return t("documents").where("text is not null").select("doc_id", F.md5(out.cast("binary")).alias("h"))


@query(f"select doc_id, md5(regexp_replace(regexp_replace(nfc_normalize(text), '^{X.BLANK}|{X.BLANK}$', '', 'g'), '{X.BLANK}', ' ', 'g')) as h from documents")
def str_normalize_unicode(t):
    """STR-08: compatibility composition and single spaces; the SQL composes canonically, the same where a text has no compatibility letter."""
    return t("documents").select("doc_id", F.md5(X.normalize_unicode(F.col("text")).cast("binary")).alias("h"))


@query("select doc_id, md5(regexp_replace(text, '\\p{C}', ' ', 'g')) as h from documents")
def str_replace_non_printing(t):
    """STR-12."""
    return t("documents").select("doc_id", F.md5(X.replace_non_printing(F.col("text")).cast("binary")).alias("h"))


@query(f"select page_id, md5(regexp_replace(html, '{X.EMOJI}\\s*', '', 'g')) as h from pages")
def str_remove_emoji(t):
    """STR-23, STR-24: emoji and the white space behind them."""
    return t("pages").select("page_id", F.md5(X.remove_emoji(F.col("html")).cast("binary")).alias("h"))


@query("select doc_id, cast(greatest(0, length(replace(text, ' ', '')) - 5) as int) as n from documents")
def str_ngrams(t):
    """STR-09: six-letter n-grams without spaces; how many and what they are."""
    return t("documents").select("doc_id", F.size(X.ngrams(F.col("text"), 6)).alias("n"))


@query(f"select page_id, md5(regexp_replace(html, {sq(X.URL)}, ' ', 'g')) as h from pages")
def str_replace_urls(t):
    """STR-10, STR-13."""
    return t("pages").select("page_id", F.md5(X.replace_urls(F.col("html")).cast("binary")).alias("h"))


@query("select page_id, md5(regexp_replace(html, '[#@]([0-9A-Za-z_]{4,})', ' ', 'g')) as h from pages")
def str_replace_tags(t):
    """STR-11."""
    return t("pages").select("page_id", F.md5(X.replace_tags(F.col("html")).cast("binary")).alias("h"))


@query("select doc_id, md5(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}_]+', ' ', 'g')) || ' ') as h from documents")
def str_toxicity_format(t):
    """STR-32: lower case, other than word letters as one space, a space at both ends; all languages."""
    f = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("text"), "[^\\p{L}\\p{N}_]+", " ")), F.lit(" "))
    return t("documents").select("doc_id", F.md5(f.cast("binary")).alias("h"))


COUNTS = ", ".join(f"struct_pack(n := length(r) - length(regexp_replace(r, '{X.script_class(n)}', '', 'g')), s := '{n}', k := {-k})" for k, n in enumerate(X.SCRIPTS))


@query(f"""with r as (select doc_id, regexp_replace(text, {sq(X.UBIQUITOUS)}, '', 'g') as r from documents where text is not null), c as (select doc_id, list_filter([{COUNTS}], lambda x: x.n > 0) as c from r),
m as (select doc_id, c, list_sum(list_transform(c, lambda x: x.n)) as total, list_max(list_transform(c, lambda x: x.n)) as top from c)
select doc_id, case when total > 0 and not (len(c) > 1 and top * len(c) = total) then list_filter(c, lambda x: x.n = top)[1].s end as script,
round(case when total > 0 and not (len(c) > 1 and top * len(c) = total) then top / total else 0 end, 6) as share from m""")
def str_script(t):
    """STR-20, CNT-27: script by code point ranges and its share."""
    s = X.script(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", s["script"].alias("script"), F.round(s["share"], 6).alias("share"))


@query("select page_id, regexp_extract(url, '^(?:https?://)?([^/]+)', 1) as host, split_part(regexp_extract(url, '^(?:https?://)?([^/]+)', 1), '.', -1) as top from pages")
def str_parse_url(t):
    """Fields of a URL by pattern."""
    host = F.regexp_extract("url", "^(?:https?://)?([^/]+)", 1)
    return t("pages").select("page_id", host.alias("host"), F.element_at(F.split(host, "\\."), -1).alias("top"))


PHRASES = ["worthless", "the", "of"]
SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def tokens_sql(t: str) -> str:
    return f"' ' || trim(regexp_replace(regexp_replace({replaced(t, X.UNICODE_PUNCT)}, '(\\p{{P}}|\\p{{S}}|\\p{{Han}})', ' \\1 ', 'g'), '{SPACE}', ' ', 'g')) || ' '"


TOKENS = tokens_sql("text")


def hits_sql(k: str, phrases: list[str]) -> str:
    """The different phrases, cut like texts, as they are and in lower case, that stand in the tokens k."""
    own = [tokens_sql(sq(p)) for p in phrases]
    every = ", ".join(f"case when contains({k}, {p}) or contains(lower({k}), {p}) then trim({p}) end" for p in own + [f"lower({p})" for p in own])
    return f"list_distinct(list_filter([{every}], lambda x: x is not null))"


@query(f"select doc_id, cast(len({hits_sql('k', PHRASES)}) as int) as n_toxic from (select doc_id, {TOKENS} as k from documents)")
def tox_phrase_counts(t):
    """TOX-01, TOX-02, TOX-04: phrases as whole tokens."""
    return t("documents").select("doc_id", F.size(X.toxic_words(F.col("text"), PHRASES)).alias("n_toxic"))


PUNCTUATED = ["The", "of,", "ed. Th", "-", "Étion dans"]


@query(f"select doc_id, array_to_string(list_sort({hits_sql('k', PUNCTUATED)}), '|') as found from (select doc_id, {TOKENS} as k from documents)")
def tox_punctuated_phrases(t):
    """TOX-01, TOX-02: phrases of several tokens and with punctuation, cut like texts; those with capitals count in lower case again."""
    return t("documents").select("doc_id", F.array_join(F.array_sort(X.toxic_words(F.col("text"), PUNCTUATED)), "|").alias("found"))


@query(
    f"""with w as (select distinct array_to_string(string_split_regex(trim(text), '\\s+')[1:2], ' ') as phrase from benchmark), p as (select {tokens_sql('phrase')} as p from w), q as (select p from p union select lower(p) from p),
d as (select doc_id, {TOKENS} as k from documents)
select doc_id, count(p) as n, coalesce(string_agg(trim(p), '|' order by trim(p)), '') as found from d left join q on contains(k, p) or contains(lower(k), p) group by doc_id"""
)
def tox_listed_phrases(t):
    """TOX-01, TOX-02: a list of phrases from a table (how the items of benchmark begin) through one automaton."""
    begins = F.array_join(F.slice(F.split(F.trim("text"), "\\s+"), 1, 2), " ")
    found = phrases.with_phrases(t("documents").select("doc_id", "text"), "doc_id", "text", t("benchmark").select(begins.alias("phrase")).distinct())
    return found.select("doc_id", F.size("phrases").cast("long").alias("n"), F.array_join("phrases", "|").alias("found"))


@query()
def tox_piece_phrases(t):
    """TOX-03: the subword checker: the phrases' pieces in a row among a text's pieces."""
    begins = F.array_join(F.slice(F.split(F.trim("text"), "\\s+"), 1, 2), " ")
    found = phrases.with_piece_phrases(t("documents").select("doc_id", "text"), "text", t("benchmark").select(begins.alias("phrase")).distinct(), "/opt/tokenizers/piece_bpe_32k.model")
    return found.select("doc_id", F.size("phrases").cast("long").alias("n"), F.array_join("phrases", "|").alias("found"))


@query(
    f"""with d as (select lang, contains(lower({TOKENS}), ' worthless ') as hit from documents)
select lang, count(*) as n, count(*) filter (hit) as n_hit, round(avg(hit::int), 6) as share from d group by lang"""
)
def tox_report(t):
    """CNT-08, TOX-05: matched rows and share by language."""
    hit = F.size(X.toxic_words(F.col("text"), ["worthless"])) > 0
    return t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(hit).alias("n_hit"), F.round(F.avg(hit.cast("int")), 6).alias("share"))


@query("select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')[1] as first_word, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as n_words from documents")
def prj_split_fields(t):
    """PRJ-01: fields of a line."""
    w = F.filter(F.split("text", "\\s+"), lambda x: x != "")
    return t("documents").select("doc_id", F.get(w, F.lit(0)).alias("first_word"), F.size(w).cast("long").alias("n_words"))


@query("select doc_id, substr(text, 4) as rest from documents where starts_with(text, 'The')")
def prj_prefixed_lines(t):
    """PRJ-06: lines by prefix."""
    return t("documents").where(F.startswith("text", F.lit("The"))).select("doc_id", F.expr("substr(text, 4)").alias("rest"))


BENGALI = "[" + ", ".join(sq(w) for w in N.BENGALI) + "]"


@query(
    f"""with w as (select {BENGALI} as w), x as (select o_orderkey, o_orderkey * 1000003 % 100000007 as n from orders)
select o_orderkey, array_to_string(list_filter([case when n >= 10000000 then w[n // 10000000 + 1] || ' কোটি' end, case when n % 10000000 >= 100000 then w[n % 10000000 // 100000 + 1] || ' লক্ষ' end,
  case when n % 100000 >= 1000 then w[n % 100000 // 1000 + 1] || ' হাজার' end, case when n % 1000 >= 100 then w[n % 1000 // 100 + 1] || ' শত' end, case when n % 100 > 0 or n = 0 then w[n % 100 + 1] end], lambda z: z is not null), ' ') as words from x, w"""
)
def str_bengali_numbers(t):
    """STR-28: numbers up to crores in Bengali words."""
    n = (F.col("o_orderkey") * 1000003 % 100000007).cast("string")
    return t("orders").select("o_orderkey", N.numbers_in_words(n, "bn").alias("words"))


@query(
    """with x as (select o_orderkey, cast(o_orderkey % 10000 as varchar) as n from orders), d as (select o_orderkey, n, unnest(range(1, length(n) + 1)) as k from x),
p as (select o_orderkey, n, k, cast(n[k] as int) as v, length(n) - k as power, coalesce(try_cast(n[k - 1] as int), -1) as before, rtrim(n[k:], '0') = '' as rest from d),
y as (select o_orderkey, string_agg(case when v > 0 then case when v = 2 and power > 1 and before <> 0 then '两' when v = 1 and power = 1 and k = 1 then '' else '零一二三四五六七八九'[v + 1] end || ['', '十', '百', '千'][power + 1]
  when n = '0' then '零' when not rest and before <> 0 then '零' else '' end, '' order by k) as words from p group by o_orderkey) select o_orderkey, words || '个' as words from y"""
)
def str_chinese_counts(t):
    """STR-29: counts up to ten thousand in Chinese words."""
    n = F.concat((F.col("o_orderkey") % 10000).cast("string"), F.lit("个"))
    return t("orders").select("o_orderkey", N.numbers_in_words(n, "zh").alias("words"))


@query()
def str_chinese_text(t):
    """STR-29: dates, money, percents and numbers that stand in texts in Chinese words."""
    d = t("orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyy年M月d日"), F.lit("付"), F.col("o_totalprice").cast("string"), F.lit("元，占"), (F.col("o_orderkey") % 100).cast("string"), F.lit("%")).alias("text"))
    return d.select("o_orderkey", N.numbers_in_words(F.col("text"), "zh").alias("text"))
