import hashlib
import itertools
import random
import re
import zlib

from weirline.llm import queries, repair

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
ROLE = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_edit(rows, flaws, most=2):
    """(cost, audit, repaired) of every edit with at most `most` inserts in a row, by trying all."""
    per_row = []
    for (role, text), flaw in zip(rows, flaws):
        ways = [("D", 3, None)]
        if flaw not in ("blank", "duplicate"):
            extra = flaw == "truncated"
            ways += [("K", extra, (role, text)), *(("R", 2 + extra, (r, text)) for r in ROLE.values())]
        per_row.append(ways)
    gaps = [g for n in range(most + 1) for g in itertools.product("ua", repeat=n)]
    for ways in itertools.product(*per_row):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for k in range(len(rows) + 1):
                cost, audit = cost + 2 * len(ins[k]), audit + "I" * len(ins[k])
                turns += [(ROLE[x], "") for x in ins[k]]
                if k < len(rows):
                    cost, audit = cost + ways[k][1], audit + ways[k][0]
                    turns += [ways[k][2]] if ways[k][2] else []
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in turns)):
                yield cost, audit, turns


def table(rows, flaws):
    """(cost, audit) by a plain table of whole audits."""
    follow = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    now = {"": (0, "")}

    def inserts(at):
        for _ in range(3):
            for state, (cost, audit) in list(at.items()):
                for x in "ua":
                    if x in follow[state]:
                        at[x] = min(at.get(x, (1e9, "")), (cost + 2, audit + "I"))
        return at

    for (role, _), flaw in zip(rows, flaws):
        new = {}
        for state, (cost, audit) in inserts(dict(now)).items():
            ways = [(state, cost + 3, audit + "D")]
            if flaw not in ("blank", "duplicate"):
                extra = flaw == "truncated"
                ways += [(x, cost + 2 + extra, audit + "R") for x in "ua" if x in follow[state]]
                if role[:1] in follow[state]:
                    ways.append((role[:1], cost + extra, audit + "K"))
            for s, c, a in ways:
                new[s] = min(new.get(s, (1e9, "")), (c, a))
        now = new
    end = inserts(dict(now))
    return min(end[s] for s in ("", "a") if s in end)


def conversation(r, n):
    texts = ["Yes.", "No!", "", " \n", "what", "so?", "and so on", "fine. "]
    return [(r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.") for _ in range(n)]


def test_all_edits_of_short_conversations():
    r = random.Random(5)
    for _ in range(60):
        rows = conversation(r, r.randint(0, 3))
        cost, audit, turns = min(every_edit(rows, faults(rows)), key=lambda x: x[:2])
        got = repair.solved([(k, *x) for k, x in enumerate(rows)]) if rows else {"cost": 0, "audit": "", "turns": []}
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert [(t["role"], t["text"]) for t in got["turns"]] == turns


def test_long_conversations_equal_a_table_of_audits():
    r = random.Random(6)
    for n in [*range(1, 40), 200, 333]:
        rows = conversation(r, n)
        got = repair.solved([(k, *x) for k, x in enumerate(rows)])
        assert (got["cost"], got["audit"]) == table(rows, faults(rows))


def plain(given):
    """The contract in plain Python over (conv_id, turn, role, text)."""
    convs = {}
    for c, t, role, text in given:
        own = convs.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(t, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = []
    for c, rows in convs.items():
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        turns = [t for t, _, _ in rows if t is not None]
        own = [(a, b) for _, a, b in rows]
        flaws = faults(own)
        cost, audit = table(own, flaws)
        body, at, state, need = [], 0, "", {"": "u", "s": "u", "u": "a", "a": "u"}
        for x in audit:
            role, text = own[at] if x != "I" else ("", "")
            at += x != "I"
            if x != "D":
                role = role if x == "K" else ROLE[need[state]]
                state = role[:1]
                body.append(f"{role}:{text}")
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, _), (b, _) in zip(own, own[1:]))
        out.append((c, gaps, flaws.count("blank"), flaws.count("duplicate"), flaws.count("truncated"), bad, cost, audit, SHA("\n".join(body))))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_query_equals_plain(spark, sf):
    given = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_repair(spark, sf)) == plain(given)


def odd_rows():
    r = random.Random(7)
    rows = [(c, t, *x) for c in range(12) for t, x in enumerate(conversation(r, r.choice([1, 2, 5, 30, 90])))]
    rows += [(50, None, "user", "a."), (50, None, None, None), (50, 3, "user", "a."), (50, 2**40, "assistant", None), (None, 1, "user", "hi."), (None, None, "assistant", "ho.")]
    rows += [(60, 0, "user", "x" * 1_000_000 + "."), (60, 1, "assistant", "y."), (60, 1, "assistant", "y.")]
    return rows


def test_odd_rows_by_query(spark, tmp_path):
    rows = odd_rows() + [(70 + k, 0, "user", "a.") for k in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as id", "2 as seq", "'x' as audit")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(queries.op12_repair(spark, str(tmp_path))) == plain(rows)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert queries.op12_repair(spark, f"{tmp_path}/none").count() == 0


def test_blocks_give_the_same(spark):
    df = spark.createDataFrame(odd_rows(), "conv_id long, turn long, role string, text string").repartition(5)
    want = rows_of(repair.digests(repair.repair(df)))
    for rows in (1, 3, 7):
        found = repair.repair(df, block_rows=rows)
        assert rows_of(repair.digests(found)) == want
    assert found.where("size(turns) > 14").count() == 0
