"""Conversation structure repair: the cheapest edits that give roles of the form (system? (user assistant)+)?, by divide and conquer.

A conversation's roles are read by four states: nothing yet, after system, after user,
after assistant. Costs of reaching each state from the front and of ending well from each
state meet at the middle row (Hirschberg): the crossing with the least sum is on a
cheapest path, and both halves are solved alone, so no table of rows x states is kept.

Of equally cheap edits the one with the ASCII-least audit is taken. The cut lies right
after a row's own edit, so all audits up to it hold as many row letters and end with one:
none is a prefix of another, and their order decides that of the whole audits. Forward
vectors carry that order as ranks of the states, which is all that a crossing needs.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import Scratch

WHITE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
INF = 1 << 60
#: Cost and letters of the inserts with which a conversation ends well from each state.
END = (0, 2 * INSERT, INSERT, 0)
TRAIL = ("", "II", "I", "")
#: The one role that a reroled or inserted turn can have in each state, and the state after it.
NEXT = (("user", USER), ("user", USER), ("assistant", ASSISTANT), ("user", USER))
#: A row's kind: 0 has to go; otherwise 1 + initial (s, u, a, other) * 2 + truncated.
INITIALS = "sua"
#: Rows and bytes of text up to which a task holds a conversation in one piece.
BLOCK_ROWS, BLOCK_BYTES = 65_536, 16 << 20


def kept(initial: int, state: int) -> int | None:
    """The state after a row with its own role, None where that role may not follow."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return None if state == USER else USER
    return ASSISTANT if initial == 2 and state == USER else None


def steps(kind: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters) of a row of a kind, inserts before it included; the cheapest, then ASCII-least of each."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    initial, cut = divmod(kind - 1, 2)
    for before in STATES:
        at, n, seen = before, 0, set()
        while at not in seen:
            seen.add(at)
            ways = [(at, DELETE, "D")]
            if kind:
                ways.append((NEXT[at][1], REROLE + cut * TRUNCATED, "R"))
                if (after := kept(initial, at)) is not None:
                    ways.append((after, cut * TRUNCATED, "K"))
            for after, cost, letter in ways:
                way = (n * INSERT + cost, "I" * n + letter)
                best[before, after] = min(best.get((before, after), way), way)
            at, n = NEXT[at][1], n + 1
    return [(p, q, cost, letters) for (p, q), (cost, letters) in sorted(best.items())]


STEPS = [steps(kind) for kind in range(9)]


def forward(kinds: bytes, costs: list[int], ranks: list[int]) -> tuple[list[int], list[int]]:
    """Least costs of each state after all rows, and the order of their ASCII-least audits; from such vectors before them."""
    for kind in kinds:
        best: list[tuple] = [(INF,)] * 4
        for p, q, cost, letters in STEPS[kind]:
            if costs[p] < INF:
                way = (costs[p] + cost, ranks[p], letters)
                if way < best[q]:
                    best[q] = way
        costs = [w[0] for w in best]
        order = sorted((w[1:], q) for q, w in enumerate(best) if w[0] < INF)
        ranks = [0] * 4
        for k, (_, q) in enumerate(order):
            ranks[q] = k
    return costs, ranks


def backward(kinds: bytes, end: list[int]) -> list[int]:
    """Least cost from each state before all rows, when `end` is what it costs after them."""
    for kind in reversed(kinds):
        costs = [INF] * 4
        for p, q, cost, _ in STEPS[kind]:
            costs[p] = min(costs[p], cost + end[q])
        end = costs
    return end


def only(state: int) -> list[int]:
    return [0 if q == state else INF for q in STATES]


def between(kinds: bytes, start: int, end: int | None) -> str:
    """The ASCII-least of the cheapest audits that lead from state start to state end, or (None) to a good end."""
    if not kinds:
        return TRAIL[start] if end is None else ""
    if len(kinds) == 1:
        last, trail = (END, TRAIL) if end is None else (only(end), ("",) * 4)
        return min((cost + last[q], letters + trail[q]) for p, q, cost, letters in STEPS[kinds[0]] if p == start)[1]
    half = len(kinds) // 2
    costs, ranks = forward(kinds[:half], only(start), [0] * 4)
    rest = backward(kinds[half:], list(END) if end is None else only(end))
    cross = min((costs[q] + rest[q], ranks[q], q) for q in STATES)[2]
    return between(kinds[:half], start, cross) + between(kinds[half:], cross, end)


@lru_cache(maxsize=65_536)
def cheapest(kinds: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    return backward(kinds, list(END))[START], between(kinds, START, None)


def edited(rows: list[tuple[str, str]], audit: str, state: int = START) -> list[dict]:
    """The turns that an audit makes of (role, text) rows."""
    out, at = [], 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else rows[at]
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K":
            state = kept(INITIALS.find(role[:1]), state)
        else:
            role, state = NEXT[state]
        out.append({"role": role, "text": text})
    return out


class Facts:
    """What one pass over the rows of a conversation, or a block of it, finds."""

    def __init__(self, rows: list[tuple], repeated: set[int] | None = None):
        """rows of (turn, role, text) in order; repeated: places of rows seen before, looked for here if None."""
        seen: set[tuple[str, str]] = set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first, self.last = rows[0][1][:1], rows[-1][1][:1]
        known = [t for t, _, _ in rows if t is not None]
        self.low, self.high = (known[0], known[-1]) if known else (None, None)
        self.turns = sum(a != b for a, b in zip(known, known[1:])) + bool(known)
        kinds = bytearray()
        for k, (_, role, text) in enumerate(rows):
            body = text.strip(WHITE)
            again = k in repeated if repeated is not None else (role, text) in seen
            if repeated is None:
                seen.add((role, text))
            cut = False
            if not body:
                self.blank += 1
            elif again:
                self.duplicate += 1
            elif cut := body[-1] not in ".!?":
                self.truncated += 1
            initial = INITIALS.find(role[:1]) if role else -1
            kinds.append(0 if not body or again else 1 + 2 * (initial if initial >= 0 else 3) + cut)
            if k:
                self.illegal += rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        self.kinds = bytes(kinds)


TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
RESULT = "id long, seq long, " + ", ".join(f"{c} long" for c in TOTALS) + ", audit string, turns array<struct<role:string,text:string>>"
PIECES = RESULT + ", rows array<struct<turn:bigint,role:string,text:string>>"
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
ROWS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))
PIECE_TYPES = pa.schema([("id", pa.int64()), ("seq", pa.int64()), *((c, pa.int64()) for c in TOTALS), ("audit", pa.string()), ("turns", TURNS), ("rows", ROWS)])
RESULT_TYPES = pa.schema(list(PIECE_TYPES)[:-1])


class Out:
    """Gathers dict rows and hands them on as batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: dict, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 100
        if self.size > 4 << 20:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
        self.rows, self.size = [], 0


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def solved(rows: list[tuple]) -> dict:
    """Totals, audit and repaired turns of a whole conversation of (turn, role, text) rows."""
    f = Facts(rows)
    cost, audit = cheapest(f.kinds)
    gaps = f.high - f.low + 1 - f.turns if f.turns else 0
    turns = edited([(role, text) for _, role, text in rows], audit)
    return {"gaps": gaps, "blank": f.blank, "duplicate": f.duplicate, "truncated": f.truncated, "illegal": f.illegal, "cost": cost, "audit": audit, "turns": turns}


def pieces(ordered: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """Solves each conversation that lies within one partition of ordered rows (id, turn, role, text); others leave as blocks (id, seq, rows).

    The first and last conversation of a partition may go on in its neighbours, and one
    beyond a block's size would fill a task's memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n = Out(PIECE_TYPES), TaskContext.get().partitionId() << 32
        held, size, here, inside = [], 0, None, False

        def block() -> Iterator[pa.RecordBatch]:
            yield from out.add({"id": here, "seq": n, "rows": [dict(zip(("turn", "role", "text"), r)) for r in held]}, size)

        for key, *row in _rows(batches):
            if held and (key != here or len(held) >= block_rows or size >= block_bytes):
                if key != here and inside:
                    yield from out.add({"id": here, **solved(held)}, size)
                else:
                    yield from block()
                    n += 1
                inside = key != here
                held, size = [], 0
            here = key
            held.append(tuple(row))
            size += len(row[2])
        if held:
            yield from block()
        yield from out.end()

    return ordered.mapInArrow(run, PIECES)


def repeats(blocks: DataFrame) -> DataFrame:
    """(seq, again): the places of a block's rows whose role and text the conversation has before; counts are pre-aggregated, and no key is a whole conversation."""
    row = blocks.select("id", "seq", F.posexplode("rows").alias("at", "r"))
    keyed = row.select("id", F.struct("seq", "at").alias("place"), F.xxhash64("r.role", "r.text").alias("h1"), F.xxhash64(F.lit(1), "r.text", "r.role").alias("h2"))
    first = keyed.groupBy("id", "h1", "h2").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n").toDF("i", "k1", "k2", "first")
    later = keyed.join(first, keyed.id.eqNullSafe(first.i) & (keyed.h1 == first.k1) & (keyed.h2 == first.k2)).where("place > first")
    return later.groupBy("place.seq").agg(F.collect_list("place.at").alias("again"))


SUMMARY = "id long, seq long, kinds binary, facts array<long>, first string, last string, costs array<long>, ranks array<long>"
FACTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")


def summaries(blocks: DataFrame) -> DataFrame:
    """SUMMARY of each block (id, seq, rows, again): its faults, and least costs and ranks of each state after it from each state before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("id", pa.int64()), ("seq", pa.int64()), ("kinds", pa.binary()), ("facts", pa.list_(pa.int64())), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("ranks", pa.list_(pa.int64()))])
        out = Out(types)
        for key, seq, rows, again in _rows(batches):
            f = Facts([(r["turn"], r["role"], r["text"]) for r in rows], set(again or ()))
            each = [forward(f.kinds, only(s), [0] * 4) for s in STATES]
            row = {"id": key, "seq": seq, "kinds": f.kinds, "facts": [getattr(f, c) for c in FACTS], "first": f.first, "last": f.last}
            yield from out.add(row | {"costs": sum((c for c, _ in each), []), "ranks": sum((r for _, r in each), [])}, len(f.kinds))
        yield from out.end()

    return blocks.select("id", "seq", "rows", "again").mapInArrow(run, SUMMARY)


def crossings(summed: DataFrame) -> DataFrame:
    """(id, seq, start, end, totals): the states in which the cheapest edits enter and leave each block (end null: the last one); totals on the first.

    A conversation's summaries pass in order through one task, which keeps 12 bytes of each.
    """
    types = pa.schema([("id", pa.int64()), ("seq", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), *((c, pa.int64()) for c in TOTALS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(types)
        seqs, back = array("q"), bytearray()
        here, facts, last, costs, ranks = None, None, "", [], []

        def finish() -> Iterator[pa.RecordBatch]:
            end = min((costs[q] + END[q], ranks[q], q) for q in STATES)
            blank, duplicate, truncated, illegal, turns, low, high = facts
            gaps = high - low + 1 - turns if turns else 0
            totals = dict(zip(TOTALS, (gaps, blank, duplicate, truncated, illegal, end[0])))
            state, rows = end[2], []
            for k in range(len(seqs) - 1, -1, -1):
                before = back[4 * k + state]
                row = {"id": here, "seq": seqs[k], "start": before, "end": None if k == len(seqs) - 1 else state}
                yield from out.add(row if k else row | totals, 0)
                state = before

        for key, seq, f, first, final, c, r in _rows(batches):
            if not seqs or key != here:
                if seqs:
                    yield from finish()
                here, facts, seqs, back = key, [0] * 5 + [None, None], array("q"), bytearray()
                costs, ranks, last = only(START), [0] * 4, None
            facts[3] += last is not None and last + first not in ("su", "ua", "au")
            facts[4] -= f[5] is not None and f[5] == facts[6]
            facts[:5] = [x + y for x, y in zip(facts, f[:5])]
            facts[5] = f[5] if facts[5] is None else facts[5]
            facts[6] = facts[6] if f[6] is None else f[6]
            best = [min(((costs[p] + c[4 * p + q], ranks[p], r[4 * p + q], p) for p in STATES if costs[p] < INF and c[4 * p + q] < INF), default=(INF, 0, 0, 0)) for q in STATES]
            order = sorted((w[1:3], q) for q, w in enumerate(best) if w[0] < INF)
            costs, ranks = [w[0] for w in best], [0] * 4
            for k, (_, q) in enumerate(order):
                ranks[q] = k
            back += bytes(w[3] for w in best)
            seqs.append(seq)
            last = final
        if seqs:
            yield from finish()
        yield from out.end()

    rows = summed.select("id", "seq", "facts", "first", "last", "costs", "ranks").repartition("id").sortWithinPartitions("id", "seq")
    return rows.mapInArrow(run, "id long, seq long, start int, end int, " + ", ".join(f"{c} long" for c in TOTALS))


def joined(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """RESULT rows of conversations that lie in several blocks, a row for each block."""
    marked = scratch.table(blocks.join(repeats(blocks), "seq", "left"))
    summed = scratch.table(summaries(marked))
    ways = crossings(summed).drop("id").join(summed.select("seq", "kinds"), "seq").join(marked.select("id", "seq", "rows"), "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Out(RESULT_TYPES)
        for key, seq, start, end, kinds, rows, *totals in _rows(batches):
            audit = between(kinds, start, end)
            texts = [(r["role"], r["text"]) for r in rows]
            turns = edited(texts, audit, start)
            yield from out.add({"id": key, "seq": seq, **dict(zip(TOTALS, totals)), "audit": audit, "turns": turns}, sum(len(t) for _, t in texts))
        yield from out.end()

    return ways.select("id", "seq", "start", "end", "kinds", "rows", *TOTALS).mapInArrow(run, RESULT)


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """RESULT rows: totals, audit and repaired turns of each conversation.

    A conversation's rows go by turn (nulls first), then role, then text (by its first 64
    characters, then by hash). Most conversations are one row with seq null. Those that a
    partition's end cuts, or that are longer than a block, are a row for each block, in
    order of seq, with the totals on the first: neither a long conversation nor a hot key
    is ever held whole. Null roles and texts count as one space; a role without s, u or a
    as its initial (an empty one too) cannot be kept as it is. Rows with a null id are one
    conversation. Repeated rows are duplicates. Empty input: empty output. Other columns
    are not read.
    """
    scratch = Scratch(rows.sparkSession, "repair")
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    keys = ["id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text")]
    parts = scratch.table(pieces(own.repartitionByRange(*keys).sortWithinPartitions(*keys), block_rows, block_bytes))
    whole = parts.where("rows is null").drop("rows")
    return whole.unionByName(joined(parts.where("rows is not null").select("id", "seq", "rows"), scratch))


def digests(results: DataFrame) -> DataFrame:
    """(id, totals, audit, repaired_sha256): one row a conversation of repair().

    The SHA-256 of a conversation in several blocks runs over them in order, a block at a time.
    """
    names = ("id", *TOTALS, "audit", "repaired_sha256")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    whole = results.where("seq is null").withColumn("repaired_sha256", F.sha2(F.encode(text, "UTF-8"), 256)).select(*names)
    types = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in TOTALS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, here, totals, audit, sha, any_turn = Out(types), None, None, [], None, False

        def finish() -> Iterator[pa.RecordBatch]:
            yield from out.add({"id": here, **dict(zip(TOTALS, totals)), "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}, len(audit))

        for key, own, letters, body, n in ((r[0], r[2:8], r[8], r[9], r[10]) for r in _rows(batches)):
            if sha is None or key != here:
                if sha is not None:
                    yield from finish()
                here, totals, audit, sha, any_turn = key, own, [], hashlib.sha256(), False
            audit.append(letters)
            if n:
                sha.update((b"\n" if any_turn else b"") + body.encode())
                any_turn = True
        if sha is not None:
            yield from finish()
        yield from out.end()

    several = results.where("seq is not null").select("id", "seq", *TOTALS, "audit", text.alias("body"), F.size("turns").alias("n"))
    schema = "id long, " + ", ".join(f"{c} long" for c in TOTALS) + ", audit string, repaired_sha256 string"
    return whole.unionByName(several.repartition("id").sortWithinPartitions("id", "seq").mapInArrow(run, schema))


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage by crc32("conv_id:turn") % 20, nulls as one space.

    0 drops the row, 1 empties its text, 2 takes its .!? out, 3 repeats it, 4 makes it the user's.
    """
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), (F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")) % 20).alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("_")
    return own.where("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times).drop("_")
