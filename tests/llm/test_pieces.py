import random

import pytest
import sentencepiece

from weirline.llm import pieces as P
from weirline.llm.common import Scratch

TEXTS = [None, "", " ", "Hello wörld", "  two  spaces   ", "line\nbreak\ttab\r\n", "😀 日本語 ẞ", "x" * 3000, "the the the The of of of of", "a▁b", "12,345.67 (x)!", "▁", "averyverylongword" * 5, "supercalifragilistic the of and", "\x00\x01"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.MODEL)


def test_merges_equal_the_library():
    m, p, r = library(), P.load(P.MODEL), random.Random(2)
    words = P.Words({}, p)
    find = P.re.compile(p.word_pattern()).findall
    texts = [t for t in TEXTS if t] + ["".join(r.choices("abcdeést  hin\n.,▁0", k=r.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        ids = P.np.frombuffer(b"".join(words[w] for w in find(P.marked(t))), "<i4")
        assert ids.tolist() == m.encode(t), t
        assert P.decode(ids, p) == t.replace("▁", " ")


def test_lattice_folds_equal_merges(spark):
    p = P.load(P.MODEL)
    words = ["▁the", "▁thereafter", "▁▁▁word", "日本", "▁é", "x" * 60, "▁", "▁unbelievably", "qzxqj", "▁Handbuch"]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    lat = P.lattice(df, P.piece_table(spark), p.longest)
    for r in P.fold(lat).collect():
        ids = [k for x in r.path for k in ([x.id] if x.id is not None else p.ids(r.word[x.s : x.e]))]
        assert ids == p.merge(r.word), r.word
    for r in P.viterbi(lat).collect():
        assert "".join(r.word[x.s : x.e] for x in r.path) == r.word


def test_table_is_bounded_and_changes_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).cache()
    m = library()
    want = {r.doc_id: m.encode(r.text) for r in docs.collect()}
    words = P.word_table(docs, table=300)
    assert 0 < len(words) <= 300
    for table in (0, 300):
        got = {r.id: r for r in P.encode(docs, table=table).collect()}
        assert {i: r.ids for i, r in got.items()} == want and all(r.round_trip and r.n_tokens == len(r.ids) for r in got.values())


def test_edges(spark):
    rows = [("i", k % 7, t, 3) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "ids string, doc_id long, text string, word int")
    m = library()
    got = P.encode(df, keep=["word"]).collect()
    assert sorted((r.id, r.ids) for r in got) == sorted((k, m.encode(t or "")) for _, k, t, _ in rows)
    assert sum(not r.round_trip for r in got) == 2 and all(r.word == 3 for r in got)
    assert P.encode(df.limit(0)).count() == 0
    assert P.frequent_words(df, Scratch(spark, "t"), table=0).count() == 0


def test_clashing_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, ids int")
    with pytest.raises(ValueError):
        P.encode(df, keep=["ids"])


def test_viterbi_has_the_best_score(spark):
    """Against all segmentations of short words, by a made-up unigram table."""
    table = {"a": -2.0, "b": -2.5, "c": -3.0, "ab": -3.0, "bc": -3.5, "abc": -7.0, "ca": -4.1, "cab": -6.0}
    words = ["abc", "cab", "abcab", "ccab", "aaa", "bcabca"]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    found = P.lattice(rows, spark.createDataFrame([(p, i, s) for i, (p, s) in enumerate(table.items())], "piece string, id int, score double"), 3)

    def best(w):
        return 0.0 if not w else max(table[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in table)

    for word, path in P.viterbi(found).collect():
        assert "".join(word[x.s : x.e] for x in path) == word and abs(sum(table[word[x.s : x.e]] for x in path) - best(word)) < 1e-9


def test_the_driver_holds_the_table_as_arrow(spark):
    """No Python object a word on the driver; tasks unpack the same ids, of words with letters that no piece covers too."""
    p = P.load(P.MODEL)
    words = ["the", "日本語", "\x01q", "thereafter", "ẞ"]
    docs = spark.createDataFrame([(k, " ".join(words * 2)) for k in range(3)], "doc_id long, text string")
    table = P.word_table(docs)
    assert isinstance(table, P.pa.Table) and min(i for x in table.column("ids").to_pylist() for i in x) < 0
    got = P.unpacked(P.packed(table), p)
    assert len(got) == len(table) >= 5 and all(P.np.frombuffer(ids, "<i4").tolist() == p.merge(w) for w, ids in got.items())
    assert P.unpacked(P.packed(table.slice(0, 0)), p) == {}


def test_words_that_read_back_need_no_decoding():
    """exact holds as long as all words read back; a text of such words decodes to itself, but for marks."""
    import copy

    p, r = P.load(P.MODEL), random.Random(4)
    words = P.Words({}, p)
    find = P.re.compile(p.word_pattern()).findall
    for t in [t for t in TEXTS if t] + ["".join(r.choices("abé日 \x00▁.,0😀\n", k=40)) for _ in range(300)]:
        ids = P.np.frombuffer(b"".join(map(words.__getitem__, find(P.marked(t)))), "<i4")
        assert words.exact and (P.decode(ids, p) == t) == (P.MARK not in t)
    bare = copy.copy(p)
    bare.byte = {}  # letters without a piece become the unknown one
    other = P.Words({}, bare)
    assert other["▁the"] and other.exact and other["ẞ"] and not other.exact
    assert not P.Words(dict(other), bare).exact
