import hashlib
import re
import time

import numpy as np

from weirline.llm import pii

RAW = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(t):
    d = [int(c) for c in t if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def plain(text):
    digits = lambda t: sum(c in "0123456789" for c in t)
    ok = {"email": lambda t: True, "ip": lambda t: all(int(p) <= 255 for p in t.split(".")), "card": lambda t: 13 <= digits(t) <= 19 and luhn(t), "phone": lambda t: 9 <= digits(t) <= 15}
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if ok[k](m[0])] for k, p in RAW.items()}


def texts():
    r = np.random.default_rng(6)
    bits = ["a@b.co", "_x@y.zz", "@", ".", "-", " ", "+1 (555) 123-4567", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "255.1.2.3", "10.0.0.1", "0", "1.2.3.256", "0001.2.3.4", "12", "7", "é", "😀", "\n", "a", "B_c", "%", "(", ")", "555-123-4567"]
    out = ["".join(r.choice(bits, r.integers(1, 14))) for _ in range(600)]
    return out + [None, "", "a" * 50_000, "1" * 50_000, "1 " * 20_000, "a@b" + ".c" * 20_000, "+1" + "2 " * 30_000, "1." * 20_000, "a@b.c " * 200]


def test_base_spans_equal_plain_patterns(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([("s", i, t, 1) for i, t in rows], "spans string, doc_id long, text string, n_ip int")
    got = {r.id: r for r in pii.find_personal(df).collect()}
    for i, t in rows:
        want = plain(t)
        named = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in want[k])
        assert got[i].base_sha256 == hashlib.sha256(named.encode()).hexdigest(), (t or "")[:80]
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(len(want[k]) for k in pii.BASE)
        assert got[i].spans.startswith(named)


def test_added_spans(spark):
    yes = ["call me at 555-123-4567 now", "reach (415) 555-2671.", "SSN 123-45-6789 ok", "jane (at) example (dot) com", "iban DE89 3704 0044 0532 0130 00 x"]
    no = ["on 2024-01-05 we met", "order no 123456789 shipped", "ISBN 978-3-1614-8410-0", "version 1.2.33.4455", "years 1999 - 2004", "plain words only", "number 4304158793483662 here", "total 1,234,567.89"]
    df = spark.createDataFrame(list(enumerate(yes + no)), "doc_id long, text string")
    got = [r.spans for r in pii.find_personal(df).orderBy("id").collect()]
    assert got[:5] == ["number:11:23", "number:6:20", "number:4:15", "address:0:27", "account:5:32"]
    assert got[5:] == [""] * len(no)


def test_held_out_precision_and_sql_equals_numpy(spark):
    model = pii.train(spark)
    rows = spark.createDataFrame(pii.examples(600, seed=77), "text string, y int")
    x = rows.select("y", pii.F.explode(pii.F.concat(*pii.candidates(pii.F.col("text")).values())).alias("x"))
    got = x.select("y", "x.*", model.sql(pii.F.col("x")).alias("p")).collect()
    m = np.array([[r[f] for f in pii.FEATURES] for r in got])
    assert np.allclose(model.score(m), [r.p for r in got])
    y, hit = np.array([r.y for r in got]), np.array([r.p for r in got]) >= model.threshold
    assert y[hit].mean() >= 0.97 and hit[y == 1].mean() >= 0.8


def test_empty_and_native(spark):
    out = pii.find_personal(spark.createDataFrame([], "doc_id long, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 0 and "Python" not in plan and "Exchange" not in plan


def test_base_ips_with_zero_parts(spark):
    yes = ["10.0.0.1", "127.0.0.1", "192.168.0.1", "0.0.0.0", "00.000.0000.8", "010.1.1.1", "255.0.00255.0"]
    no = ["10.0.0.256", "0.0.0.0300", "999.0.0.1"]
    df = spark.createDataFrame(list(enumerate(f"at {t} now" for t in yes + no)), "doc_id long, text string")
    got = [(r.n_ip, r.base_sha256) for r in pii.find_personal(df).orderBy("id").collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == [(1, sha(f"ip:3:{3 + len(t)}")) for t in yes] + [(0, sha(""))] * len(no)


def test_long_text_with_many_matches(spark):
    one = "mail joe@example.org or 555-123-4567 and 10.0.0.1, jane (at) example (dot) com, +1 555 123 45 67 "
    n = 20_000
    df = spark.createDataFrame([(1, one * n), (2, one)], "doc_id long, text string")
    began = time.time()
    got = {r.id: r for r in pii.find_personal(df).collect()}
    assert time.time() - began < 60
    assert (got[1].n_email, got[1].n_ip, got[1].n_phone) == (n, n, n) and (got[2].n_email, got[2].n_ip, got[2].n_phone) == (1, 1, 1)
    want = plain(one * n)
    named = ",".join(f"{k}:{s}:{e}" for k in pii.BASE for s, e in want[k])
    assert got[1].base_sha256 == hashlib.sha256(named.encode()).hexdigest() and got[1].spans.startswith(named + ",number:24:36,number:")
    assert got[1].spans.count("number:") == n and got[1].spans.count("address:") == n


def test_added_spans_equal_a_plain_version(spark):
    """Overlaps with base spans and between kinds, against loops over all pairs."""
    r = np.random.default_rng(11)
    bits = ["call 555-123-4567", "415 555 2671", "(at)", "jane (at) 5551234567 (dot) com", "DE89 3704 0044 0532 0130 00", "GB12BARC20010212345678", "a@b.co", "10.0.0.1", "+1 555 123 45 67", "4111 1111 1111 1111", " ", "-", ", ", "x"]
    rows = [(i, " ".join(r.choice(bits, r.integers(1, 12)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(spark)
    x = pii.F.explode(pii.F.concat(*pii.candidates(pii.F.col("text")).values())).alias("x")
    scored = df.select("doc_id", x).select("doc_id", "x.s", "x.e", "x.kind", model.sql(pii.F.col("x")).alias("p")).collect()
    got = {q.id: q.spans for q in pii.find_personal(df).collect()}
    n = 0
    for i, t in rows:
        base = [(s, e) for spans in plain(t).values() for s, e in spans]
        own = [q for q in scored if q.doc_id == i and q.p >= model.threshold and not any(q.s < e and s < q.e for s, e in base)]
        stay = [q for q in own if not any((-o.p, o.kind, o.s) < (-q.p, q.kind, q.s) and q.s < o.e and o.s < q.e for o in own)]
        want = [f"{pii.KINDS[q.kind]}:{q.s}:{q.e}" for q in sorted(stay, key=lambda q: (q.kind, q.s))]
        named = [f"{k}:{s}:{e}" for k in pii.BASE for s, e in plain(t)[k]]
        assert got[i] == ",".join(named + want), t
        n += len(want)
    assert n > 100
