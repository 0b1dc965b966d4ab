"""Queries of sentence splitting, language filters, bitext filters and their drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirline.functions import sentences as S
from weirline.functions import text as X
from weirline.operators import filters, langid, lattice
from weirline.plans.registry import query
from weirline.plans.strings import GATE, PAIRS, n_of, pairs, replaced, sq

SENTENCES = f"string_split(regexp_replace(text, '({S.END})\\s+({S.START.replace(chr(39), chr(39) * 2)})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
CLEAN = f"regexp_replace(regexp_replace(nfc_normalize(regexp_replace({replaced('raw', X.UNICODE_PUNCT)}, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g')), '^{X.BLANK}|{X.BLANK}$', '', 'g'), '{X.BLANK}', ' ', 'g')"
SPLIT = f"(select doc_id, lang, source, unnest({SENTENCES}) as raw, unnest(range(0, len({SENTENCES}))) as pos from documents)"


def sentences(t):
    return t("documents").select("doc_id", "lang", "source", F.posexplode(S.split_sentences(F.col("text"))).alias("pos", "raw"))


@query(f"select doc_id, pos, md5(raw) as raw, md5({CLEAN}) as clean from {SPLIT}")
def str_sentences(t):
    """STR-14, STR-15: sentences of every whole text, raw and cleaned, as hashes."""
    s = sentences(t).withColumn("clean", S.clean_sentence(F.col("raw")))
    return s.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5(F.col("raw").cast("binary")).alias("raw"), F.md5(F.col("clean").cast("binary")).alias("clean"))


@query("select doc_id, len(w) as n, md5(array_to_string(w, chr(1))) as h from (select doc_id, regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}_]+|[^\\s\\p{L}\\p{M}\\p{N}_]') as w from documents)")
def str_word_tokens(t):
    """STR-22: words and punctuation marks."""
    w = t("documents").select("doc_id", S.word_tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", "\u0001").cast("binary")).alias("h"))


def counted(k: str, t: str = "text") -> str:
    return f"len(list_filter(string_split_regex(lower({t}), '[^\\p{{L}}]+'), lambda w: w in ({', '.join(map(sq, S.STOP_WORDS[k].split()))})))"


def lid_sql(t: str = "text") -> str:
    best = f"list_sort([{', '.join(f'struct_pack(n := -{counted(k, t)}, lang := {sq(k)})' for k in S.STOP_WORDS)}])"
    return best


@query(f"with s as (select doc_id, {lid_sql()} as s from documents where text is not null), p as (select doc_id, s[1].lang as lang, -s[1].n as n, -list_sum(list_transform(s, lambda x: x.n)) as total from s) select doc_id, case when total = 0 then '__label__unk' else lang end as lang, round(case when total = 0 then 0 else n / total end, 6) as prob from p")
def str_language(t):
    """STR-21: language of every whole text and its share."""
    p = S.predict_language(F.col("text"))
    return t("documents").where("text is not null").select("doc_id", p["lang"].alias("lang"), F.round(p["prob"], 6).alias("prob"))


LANG = {"de": "deu_Latn", "en": "eng_Latn", "es": "es-MX", "fr": "hi_IN_rom"}


@query(f"with c as (select doc_id, case lang {' '.join(f'when {sq(a)} then {sq(b)}' for a, b in LANG.items())} else lang end as code from documents) select doc_id, nullif(regexp_extract(code, '^([a-z]{{2,3}})(?:[_-]|$)', 1), '') as language, case when regexp_matches(code, '^[a-z]{{2}}_[A-Z]{{2}}_rom$') then 'Latn' else nullif(regexp_extract(code, '^[a-z]{{2,3}}[_-]([A-Z][a-z]{{3}})', 1), '') end as script, nullif(regexp_extract(code, '[_-]([A-Z]{{2}})(?:[_-]|$)', 1), '') as region from c")
def str_language_codes(t):
    """STR-33: fields of language codes of several forms."""
    code = F.coalesce(F.create_map(*(F.lit(x) for kv in LANG.items() for x in kv))[F.col("lang")], F.col("lang"))
    f = S.language_fields(code)
    return t("documents").select("doc_id", *(f[k].alias(k) for k in ("language", "script", "region")))


SPEECH_SQL = """with r as (select conv_id, turn, array_to_string(list_transform(list_filter(string_split_regex(replace(replace(replace(text, '`', ''''), '’ ', ' '), '’', ''''), '\\s+'), lambda w: w <> ''), lambda w: case when upper(w) = w and lower(w) <> w then array_to_string(string_split(w, ''), ' ') else w end), ' ') as x from conversations),
l as (select conv_id, turn, trim({brackets}) as x from (select conv_id, turn, lower(x) as x from r)), a as (select conv_id, turn, {short} as x from l)
select conv_id, turn, md5(regexp_replace({punct}, '\\s+', ' ', 'g')) as h from a"""
_br, _ab = "x", "x"
for _ in range(3):
    _br = f"regexp_replace({_br}, '[(\\[（][^()\\[\\]（）]*[)\\]）]', '', 'g')"
for _a, _b in S.ABBREVIATIONS.items():
    _ab = f"regexp_replace({_ab}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){_a}\\.', '\\1{_b}', 'g')"
_KEPT = "".join(c for c in S.SPOKEN_PUNCT if c not in S.TO_SPACE)


@query(SPEECH_SQL.format(brackets=_br, short=_ab, punct=f"regexp_replace(regexp_replace(x, {sq(X.any_of(S.TO_SPACE))}, ' ', 'g'), {sq(X.any_of(_KEPT))}, '', 'g')"))
def str_speech_clean(t):
    """STR-25, STR-26: the speech cleaners in order on a column."""
    return t("conversations").select("conv_id", "turn", F.md5(S.clean_for_speech(F.col("text")).cast("binary")).alias("h"))


@query("select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\\[][^>\\]]*[>\\]]', '', 'g'), '\\([^)]+\\)', '', 'g'), '[\\p{M}\\p{S}\\p{P}]', ' ', 'g'), '\\s+', ' ', 'g'))) as h from documents")
def str_spoken_form(t):
    """STR-31: transcripts in their basic normal form."""
    return t("documents").select("doc_id", F.md5(S.spoken_form(F.col("text")).cast("binary")).alias("h"))


@query("select page_id, md5(lower(replace(replace(replace(replace(replace(regexp_replace(html, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'))) as h from pages")
def str_cli_chain(t):
    """STR-35: control letters out, entities undone, lower case."""
    c = X.remove_non_printing(F.col("html"))
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return t("pages").select("page_id", F.md5(F.lower(c).cast("binary")).alias("h"))


QUICK_GATE = GATE.split("when coalesce((select")[0] + "end"
RUNS = " or ".join(f"contains(t, repeat({sq(c)}, 21))" for c in "abcdefghijklmnopqrstuvwxyz -.=_*")
STRIPPED = f"regexp_replace(regexp_replace(clean, {sq(X.URL)}, ' ', 'g'), '[#@]([0-9A-Za-z_]{{4,}})', ' ', 'g')"
OTHER = "regexp_matches(regexp_replace(p, " + sq(X.UBIQUITOUS) + ", '', 'g'), '[^\\x{0}-\\x{24f}]')"
STEPS = ["filtered", "extra_filtered", "script_filtered", "lid_filtered", "lid_mismatch"]


@query(
    f"""with s as (select doc_id, lang, {CLEAN} as clean from {SPLIT}), p as (select *, {STRIPPED} as p from s),
g as (select *, (select {QUICK_GATE} from (select clean as t)) as g1, (select {QUICK_GATE} from (select p as t)) as g2, {lid_sql('p')} as l from p),
q as (select *, l[1].lang as pred, case when list_sum(list_transform(l, lambda x: x.n)) = 0 then 0 else l[1].n / list_sum(list_transform(l, lambda x: x.n)) end as prob from g),
r as (select lang, case when g1 is not null then 'filtered' when g2 is not null then 'extra_filtered' when regexp_replace(p, {sq(X.UBIQUITOUS)}, '', 'g') = '' or {OTHER} then 'script_filtered' when prob < 0.4 then 'lid_filtered' when pred <> lang then 'lid_mismatch' end as reason from q)
select lang, count(*) as total_before, count(*) filter (reason is null) as total_after, {", ".join(f"count(*) filter (reason = '{x}') as n_{x}" for x in STEPS)} from r where lang is not null group by lang"""
)
def flt_monolingual_lines(t):
    """FLT-10, CNT-01: sentence by sentence: gate, gate without URLs and tags, script, language and its threshold; counters by language."""
    s = sentences(t).where("lang is not null").withColumn("clean", S.clean_sentence(F.col("raw")))
    s = s.withColumn("gate", X.quality_reason(F.col("clean")))
    s = s.withColumn("p", F.when(F.col("gate").isNull(), X.replace_tags(X.replace_urls(F.col("clean")))))  # null, and no more work, where the gate rejects
    s = s.withColumn("script", F.when(F.col("p").isNotNull(), X.script(F.col("p")))).withColumn("lid", F.when(F.col("p").isNotNull(), S.predict_language(F.col("p"))))
    rules = [
        ("filtered", F.col("gate").isNotNull()),
        ("extra_filtered", (F.col("p") != F.col("clean")) & X.quality_reason(F.col("p")).isNotNull()),  # else the gate has passed it
        ("script_filtered", (F.col("script.share") < 1.0) | F.col("script.script").isNull()),
        ("lid_filtered", F.col("lid.prob") < 0.4),
        ("lid_mismatch", F.col("lid.lang") != F.col("lang")),
    ]
    return filters.counters(filters.chain(s, rules), "lang", STEPS)


PROB = "case when list_sum(list_transform({s}, lambda x: x.n)) = 0 then 0 else coalesce(list_filter({s}, lambda x: x.lang = 'en')[1].n / list_sum(list_transform({s}, lambda x: x.n)), 0) + 0.0 end"


@query(f"with l as (select conv_id, turn, {lid_sql('src')} as a, {lid_sql('tgt')} as b from {PAIRS}), p as (select conv_id, turn, {PROB.format(s='a')} as src_prob, {PROB.format(s='b')} as tgt_prob from l) select conv_id, turn, round(src_prob, 6) as src_prob, round(tgt_prob, 6) as tgt_prob, src_prob >= 0.5 and tgt_prob >= 0.5 as keep from p")
def flt_language_pairs(t):
    """FLT-07: probability of the expected language on both sides against thresholds."""
    prob = lambda c: S.language_share(F.col(c), "en")
    p = pairs(t).select("conv_id", "turn", prob("src").alias("src_prob"), prob("tgt").alias("tgt_prob"))
    return p.select("conv_id", "turn", F.round("src_prob", 6).alias("src_prob"), F.round("tgt_prob", 6).alias("tgt_prob"), filters.language_accepts(F.col("src_prob"), F.col("tgt_prob"), 0.5, 0.5).alias("keep"))


@query(f"with l as (select a.doc_id, b.doc_id as other, a.lang as src, b.lang as tgt, {lid_sql('a.text')}[1].lang as pa, {lid_sql('b.text')}[1].lang as pb from documents a join documents b on b.doc_id = a.doc_id + 1) select doc_id, coalesce(not (pa = tgt and src <> tgt or pb = src and src <> tgt), true) as accept from l")
def flt_crossed_languages(t):
    """FLT-17: pairs go whose source reads as the target language or the other way round."""
    d = t("documents").select("doc_id", "lang", S.language_scores(F.col("text"))[0]["lang"].alias("p"))
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("lang").alias("tgt"), F.col("p").alias("pb"))
    crossed = (F.col("lang") != F.col("tgt")) & ((F.col("p") == F.col("tgt")) | (F.col("pb") == F.col("lang")))
    return d.join(nxt, "doc_id").select("doc_id", F.coalesce(~crossed, F.lit(True)).alias("accept"))


TOX = ["the", "and"]
N_TOX = lambda c: " + ".join(f"cast(contains(' ' || trim(regexp_replace(regexp_replace(lower({c}), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '\\s+', ' ', 'g')) || ' ', ' {p} ') as int)" for p in TOX)
DRIVER = ["score", "min_len", "max_len", "max_len_ratio", "lid", "tox", "pair_dedup"]


@query(
    f"""with s as (select *, (conv_id * 7 + turn * 3) % 10 / 10 as score, {PROB.format(s=lid_sql('tgt'))} as prob, {N_TOX('src')} as xs, {N_TOX('tgt')} as xt from {PAIRS}),
r as (select *, case when score <> 0 and score < 0.2 then 'score' when length(src) < 5 or length(tgt) < 5 then 'min_len' when length(src) > 1000 or length(tgt) > 1000 then 'max_len'
  when greatest(length(src) / length(tgt), length(tgt) / length(src)) > 9 then 'max_len_ratio' when prob < 0.1 then 'lid' when abs(xs - xt) > 1 then 'tox' end as a from s),
d as (select *, case when a is null and row_number() over (partition by a is null, src, tgt order by conv_id, turn) > 1 then 'pair_dedup' else a end as reason from r)
select conv_id % 5 as part, count(*) as total_before, count(*) filter (reason is null) as total_after, {", ".join(f"count(*) filter (reason = '{x}') as n_{x}" for x in DRIVER)} from d group by 1"""
)
def flt_direction(t):
    """FLT-08, FLT-11: the filter driver of one direction: score, lengths, language, toxicity, then duplicates among what is left; counters."""
    score = (F.col("conv_id") * 7 + F.col("turn") * 3) % 10 / 10
    p = pairs(t).withColumns({"part": F.col("conv_id") % 5, "score": score, "prob": S.language_share(F.col("tgt"), "en"), "xs": F.size(X.toxic_words(F.col("src"), TOX)), "xt": F.size(X.toxic_words(F.col("tgt"), TOX))})
    length = filters.length_reason(F.col("src"), F.col("tgt"), 5, 1000, 9.0)
    rules = [("score", ~filters.score_at_least(F.col("score"), 0.2)), *((k, length == k) for k in ("min_len", "max_len", "max_len_ratio")), ("lid", F.col("prob") < 0.1), ("tox", F.abs(F.col("xs") - F.col("xt")) > 1)]
    judged = filters.chain(p, rules)
    return filters.counters(filters.reject_repeats(judged, ["src", "tgt"], ["conv_id", "turn"], "pair_dedup"), "part", DRIVER)


@query(f"select conv_id, turn from (select conv_id, turn, (conv_id * 7 + turn * 3) % 100 / 100 as score from {PAIRS}) where score >= 0.5 order by score desc, conv_id, turn limit 100")
def flt_mined_cut(t):
    """FLT-13, FLT-14, SRT-03: pairs of at least a score, best first, at most so many lines (the feature)."""
    p = pairs(t).select("conv_id", "turn", ((F.col("conv_id") * 7 + F.col("turn") * 3) % 100 / 100).alias("score"))
    return p.where("score >= 0.5").orderBy(F.desc("score"), "conv_id", "turn").limit(100).select("conv_id", "turn")


@query("select l_orderkey, l_linenumber from lineitem where l_discount <= 0.06 and l_quantity / 50 >= 0.3 and l_tax >= 0.02 and l_extendedprice / 100000 >= 0.2 and l_quantity * 2 >= 20")
def flt_candidates(t):
    """FLT-15: candidate pairs by gap, duration ratio and three similarities."""
    c = [F.col("l_discount") <= 0.06, F.col("l_quantity") / 50 >= 0.3, F.col("l_tax") >= 0.02, F.col("l_extendedprice") / 100000 >= 0.2, F.col("l_quantity") * 2 >= 20]
    out = t("lineitem")
    for x in c:
        out = out.where(x)
    return out.select("l_orderkey", "l_linenumber")


SPLIT_OF = lambda c: f"string_split(regexp_replace({c}, '({S.END})\\s+({S.START.replace(chr(39), chr(39) * 2)})', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query(
    f"""with p as (select conv_id, turn, {SPLIT_OF('src')} as a, {SPLIT_OF('tgt')} as b from {PAIRS}), z as (select conv_id, turn, unnest(range(1, least(len(a), len(b)) + 1)) as k, a, b from p), s as (select conv_id, turn, k, a[k] as src, b[k] as t from z)
select conv_id % 5 as part, count(*) as total, count(*) filter (length(t) >= 20 and {n_of(X.DIGITS)} / length(t) <= 0.2) as kept, cast(coalesce(sum(length(src)) filter (length(t) >= 20 and {n_of(X.DIGITS)} / length(t) <= 0.2), 0) as bigint) as src_chars from s group by 1"""
)
def flt_bitext_sentences(t):
    """FLT-19, CNT-03, UDF-07: both sides split and zipped to the shorter; what the target's gate rejects goes with its source; counters."""
    z = pairs(t).select("conv_id", F.arrays_zip(S.split_sentences(F.col("src")).alias("src"), S.split_sentences(F.col("tgt")).alias("t")).alias("z"), F.least(F.size(S.split_sentences(F.col("src"))), F.size(S.split_sentences(F.col("tgt")))).alias("n"))
    s = z.select("conv_id", F.explode(F.slice("z", F.lit(1), F.col("n"))).alias("x")).select((F.col("conv_id") % 5).alias("part"), "x.src", "x.t")
    keep = (F.length("t") >= 20) & (X.number_ratio(F.col("t")) <= 0.2)
    return s.groupBy("part").agg(F.count("*").alias("total"), F.count_if(keep).alias("kept"), F.coalesce(F.sum(F.when(keep, F.length("src"))), F.lit(0)).cast("long").alias("src_chars"))


@query(f"with w as (select conv_id, turn, len(list_filter(string_split_regex(src, '\\s+'), lambda w: w <> '')) as a, len(list_filter(string_split_regex(tgt, '\\s+'), lambda w: w <> '')) as b from {PAIRS}) select conv_id, turn from w where a between 1 and 250 and b between 1 and 250 and a <= 2.5 * b and b <= 2.5 * a")
def flt_clean_corpus(t):
    """FLT-18: word counts from 1 to 250 and their ratio up to 2.5."""
    n = lambda c: F.size(F.filter(F.split(c, "\\s+"), lambda w: w != ""))
    w = pairs(t).select("conv_id", "turn", n("src").alias("a"), n("tgt").alias("b"))
    return w.where("a between 1 and 250 and b between 1 and 250 and a <= 2.5 * b and b <= 2.5 * a").select("conv_id", "turn")


@query(f"with g as (select conv_id, turn, replace(text, ' ', '') as x from conversations), n as (select conv_id, turn, x[i:i + 5] as gram from (select *, unnest(range(1, length(x) - 4)) as i from g)) select conv_id, turn, round(count(distinct gram) / count(*), 6) as ratio from n group by conv_id, turn")
def flt_unique_ngrams(t):
    """FLT-05: share of different six-letter n-grams."""
    g = t("conversations").select("conv_id", "turn", X.ngrams(F.col("text"), 6).alias("g")).where("size(g) > 0")
    return g.select("conv_id", "turn", F.round(F.size(F.array_distinct("g")) / F.size("g"), 6).alias("ratio"))


@query(f"select conv_id, turn, x1 as n_src, x2 as n_tgt from (select conv_id, turn, {N_TOX('src')} as x1, {N_TOX('tgt')} as x2 from {PAIRS}) where x1 > 0 or x2 > 0")
def flt_either_toxic(t):
    """FLT-21: pairs with a phrase on either side."""
    p = pairs(t).select("conv_id", "turn", F.size(X.toxic_words(F.col("src"), TOX)).alias("n_src"), F.size(X.toxic_words(F.col("tgt"), TOX)).alias("n_tgt"))
    return p.where("n_src > 0 or n_tgt > 0")


@query(f"select doc_id, {' + '.join(f'''cast(contains(lower(text), '{p}') as int)''' for p in ['worth', 'the', 'ß'])} as n_substring from documents")
def tox_substrings(t):
    """TOX-03: the substring checker."""
    return t("documents").select("doc_id", F.size(X.toxic_substrings(F.col("text"), ["worth", "the", "ß"])).alias("n_substring"))


@query()
def str_dictionary_words(t):
    """STR-22: the items of benchmark without their spaces, in Thai letters, cut by a dictionary of the documents' words."""
    thai = lambda c: F.translate(F.lower(c), "abcdefghijklmnopqrstuvwxyz", "กขคงจฉชซญดตถทธนบปผฝพฟมยรลว")
    words = t("documents").where("lang = 'en'").select(F.explode(F.split(thai(F.regexp_replace("text", "[^A-Za-z\\s]", "")), "\\s+")).alias("word"))
    runs = t("benchmark").select("item_id", thai(F.regexp_replace("text", "[^A-Za-z]", "")).alias("run"))
    found = lattice.dictionary_words(runs, "run", words.groupBy("word").agg(F.count("*").alias("n")))
    return found.select("item_id", F.size("words").alias("n"), F.array_join("words", " ").alias("words"))


LANGUAGE_SQL = """with t as (select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ' as x from documents where text is not null),
g as materialized (select doc_id, lang, x[i:i + 2] as gram from (select *, unnest(range(1, length(x) - 1)) as i from t)),
c as materialized (select lang as label, gram, count(*) as n from g where lang is not null and doc_id % 5 <> 0 group by all having count(*) >= 5),
tot as (select label, sum(n) + (select count(distinct gram) from c) as total from c group by label),
o as materialized (select doc_id, gram, count(*) as k from g group by all),
s as (select doc_id, label, sum(k * ln((coalesce(n, 0) + 1) / total)) as s, sum(k) as size from o cross join tot left join c using (label, gram) group by all),
r as (select *, row_number() over (partition by doc_id order by s desc, label) as r, s - lead(s) over (partition by doc_id order by s desc, label) as lead, max(s) over (partition by doc_id) as top from s),
p as (select doc_id, max(label) filter (r = 1) as label, 1 / sum(exp(s - top)) as prob, max(lead / size) filter (r = 1) as margin from r group by doc_id)"""


def language_model(t):
    return langid.train(t("documents").where("doc_id % 5 <> 0"), "text", "lang")


@query(f"{LANGUAGE_SQL} select doc_id, label, round(prob, 4) as prob, round(margin, 5) as margin from p")
def str_language_model(t):
    """STR-21: the language of every text by a model of letter trigrams, trained on four fifths of the labelled texts."""
    d = t("documents").where("text is not null").select("doc_id", langid.predicted(F.col("text"), language_model(t)).alias("p"))
    return d.where("p is not null").select("doc_id", "p.label", F.round("p.prob", 4).alias("prob"), F.round("p.margin", 5).alias("margin"))


@query(
    f"""{LANGUAGE_SQL} select d.lang, count(*) as n, count(*) filter (coalesce(label = d.lang and prob >= case d.lang when 'en' then 0.9 when 'de' then 0.99 else 0.5 end, false)) as kept
from documents d left join p using (doc_id) where d.doc_id % 5 = 0 group by d.lang"""
)
def flt_language_model(t):
    """FLT-07, FLT-10, FLT-17: held-out rows whose predicted language is their own, with a threshold for each label; counters."""
    d = t("documents").where("doc_id % 5 = 0").select("lang", langid.predicted(F.col("text"), language_model(t)).alias("p"))
    keep = langid.accepted(F.col("p"), F.col("lang"), {"en": 0.9, "de": 0.99})
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(keep).alias("kept"))
