"""SentencePiece encoding and decoding with a relational lattice: substrings joined to the piece table, folded per word."""

from __future__ import annotations

import heapq
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirline.llm.common import Scratch

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of which the lattice table has at most this many, the most frequent; places are bits of a long, hence their length.
TABLE = 1 << 18
TABLE_LETTERS = 60
#: Tasks the lattice is dealt to: its words are few bytes, but each is much work.
LATTICE_TASKS = 64
#: Words a worker keeps that are not in the table.
KEPT = 1 << 19


class Pieces:
    """The piece table of a model file: ids, scores, byte pieces, and the letters no longer piece has."""

    def __init__(self, proto: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        self.unknown = m.unk_id()
        self.byte = {int(names[i][3:-1], 16): i for i in range(n) if m.is_byte(i)}
        self.plain = {names[i]: (i, m.get_score(i)) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.longest = max(map(len, self.plain))
        joined = {c for p in self.plain if len(p) > 1 for c in p}
        inside = [p for p in self.plain if MARK in p.lstrip(MARK)]
        if inside:
            raise ValueError("pieces with the mark behind a letter: words of such a model are not independent")
        self.alone = "".join(chr(c) for c in range(128) if chr(c) not in joined)
        self.bytes = [b""] * n
        for p, (i, _) in self.plain.items():
            self.bytes[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.bytes[i] = bytes([b])

    def word_pattern(self) -> str:
        """Words: marks and what follows them. Letters that no longer piece has stand alone."""
        alone = "".join(f"\\x{ord(c):02x}" for c in self.alone)
        return f"{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone}]"

    def merge(self, word: str) -> list[int]:
        """Ids of a word: the pair of neighbours whose union has the best score merges first, the leftmost of equals."""
        plain, n = self.plain, len(word)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # symbol at i is word[i:end[i]]
        alive, heap = [True] * n, []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (hit := plain.get(word[a : end[b]])):
                heapq.heappush(heap, (-hit[1], a, b, end[b]))

        for i in range(n):
            offer(i)
        while heap:
            _, a, b, e = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and end[a] == b and end[b] == e):
                continue
            alive[b], end[a] = False, e
            if e < n:
                prev[e] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        out, i = [], 0
        while i < n:
            out += self.ids(word[i : end[i]])
            i = end[i]
        return out

    def ids(self, symbol: str) -> list[int]:
        """A piece's id, or its bytes', or the unknown one."""
        if hit := self.plain.get(symbol):
            return [hit[0]]
        raw = symbol.encode("utf-8", "surrogatepass")
        return [self.byte[b] for b in raw] if all(b in self.byte for b in raw) else [self.unknown]


@lru_cache(maxsize=2)
def of_bytes(proto: bytes) -> Pieces:
    return Pieces(proto)


def load(path: str) -> Pieces:
    """The pieces of a model file that this process can read: the driver; tasks get the file's bytes."""
    return of_bytes(Path(path).read_bytes())


def marked(text: str | None) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def frequent_words(docs: DataFrame, scratch: Scratch, text_col: str = "text", model: str = MODEL, table: int = TABLE, made: list[DataFrame] | None = None) -> DataFrame:
    """(word, n): the words that occur at least c times in all documents, for the least c that leaves at most `table` words.

    Words are counted over all whole texts with partial aggregates; c comes from a
    histogram of the counts, so there is no global order and no task sees all words.
    """
    text = F.concat(F.lit(MARK), F.translate(F.col(text_col).cast("string"), " ", MARK))
    words = docs.where(F.col(text_col).cast("string") != "").select(F.explode(F.regexp_extract_all(text, F.lit(load(model).word_pattern()), F.lit(0))).alias("word"))
    counted = scratch.table(words.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.length("word") <= TABLE_LETTERS)))
    if made is not None:
        made.append(counted)
    least, total = 2, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toLocalIterator():  # one row per distinct count
        total += r.k
        if total > table:
            least = r.n + 1
            break
    return counted.where(F.col("n") >= least)


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(piece, id, score) of a model file: a fixed number of rows."""
    return spark.createDataFrame([(p, i, s) for p, (i, s) in load(model).plain.items()], "piece string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, edges): the pieces in each word as structs (cost, s, e, id, inside), best score first, then leftmost.

    Substrings of at most `longest` letters are exploded and equi-joined to the piece
    table, and edges grouped by word; words come hash-partitioned and stay so.
    inside has the bits of the places strictly between s and e.
    """
    n = F.length("word")
    dealt = words.select("word").repartition(LATTICE_TASKS, "word")
    at = dealt.select("word", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    cut = at.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(n, F.col("s") + longest))).alias("e"))
    edges = cut.withColumn("piece", F.col("word").substr(F.col("s") + 1, F.col("e") - F.col("s"))).join(F.broadcast(pieces), "piece")
    inside = F.expr("shiftleft(1L, e) - shiftleft(2L, s)")
    return edges.groupBy("word").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("cost"), "s", "e", "id", inside.alias("inside")))).alias("edges"))


def fold(lat: DataFrame) -> DataFrame:
    """(word, path): the pieces and uncovered letters of each word in order, as structs (s, e, id), id null for a letter.

    State of the fold is the set of places between symbols, a bit each. A step takes the
    first edge whose ends are in the set with one place of it between them, and takes
    that place out: the merge of two neighbours with the best score.
    """
    # the end state and the cuts are bound as variables of one expression: as columns they would be worked out again for each letter
    return lat.selectExpr(
        "word",
        """aggregate(
             sequence(1, length(word)),
             named_struct('at', shiftleft(1L, length(word) + 1) - 1L, 'on', true),
             (a, k) -> if(not a.on, a, transform(array(get(filter(edges, x -> x.e - x.s > 1
                 and (a.at & x.inside) <> 0L and (a.at & x.inside & ((a.at & x.inside) - 1L)) = 0L
                 and getbit(a.at, x.s) = 1 and getbit(a.at, x.e) = 1), 0)),
               x -> if(x is null, named_struct('at', a.at, 'on', false), named_struct('at', a.at & ~x.inside, 'on', true)))[0]),
             a -> transform(array(filter(sequence(0, length(word)), i -> getbit(a.at, i) = 1)),
               cuts -> transform(slice(cuts, 1, size(cuts) - 1), (s, i) -> named_struct('s', s, 'e', get(cuts, i + 1),
                 'id', get(filter(edges, x -> x.s = s and x.e = get(cuts, i + 1)), 0).id)))[0]) as path""",
    )


def viterbi(lat: DataFrame) -> DataFrame:
    """(word, path) as fold() gives it, but of the highest sum of scores, as unigram models ask; letters without a piece cost 1e6."""
    best = """aggregate(sequence(1, length(word)), array(named_struct('cost', 0D, 's', 0, 'id', cast(null as int))),
        (a, k) -> concat(a, array(array_min(concat(
          array(named_struct('cost', a[k - 1].cost + 1e6D, 's', k - 1, 'id', cast(null as int))),
          transform(filter(edges, x -> x.e = k), x -> named_struct('cost', a[x.s].cost + x.cost, 's', x.s, 'id', x.id)))))))"""
    back = """aggregate(sequence(1, length(word)), named_struct('e', length(word), 'path', cast(array() as array<struct<s:int,e:int,id:int>>)),
        (a, k) -> if(a.e = 0, a, named_struct('e', best[a.e].s, 'path', concat(array(named_struct('s', best[a.e].s, 'e', a.e, 'id', best[a.e].id)), a.path))), a -> a.path)"""
    return lat.selectExpr("word", "edges", f"{best} as best").selectExpr("word", f"{back} as path")


def word_table(docs: DataFrame, text_col: str = "text", model: str = MODEL, table: int = TABLE, how: str = "merge") -> pa.Table:
    """(word, ids) of at most `table` frequent words (60 letters at most), from the relational lattice; id -1 - s: the letter at s, which no piece covers.

    The driver holds the rows as Arrow only, some bytes a word, and makes no object of any.
    """
    spark = docs.sparkSession
    p, scratch = load(model), Scratch(spark, "pieces")
    made: list[DataFrame] = []
    words = frequent_words(docs, scratch, text_col, model, table, made)
    lat = words.select("word").join(lattice(words, piece_table(spark, model), p.longest), "word", "left").withColumn("edges", F.coalesce("edges", F.expr("cast(array() as array<struct<cost:double,s:int,e:int,id:int,inside:bigint>>)")))
    out = (fold if how == "merge" else viterbi)(lat).selectExpr("word", "transform(path, x -> coalesce(x.id, -1 - x.s)) as ids").toArrow()
    scratch.drop(*made)
    return out


def packed(table: pa.Table) -> bytes:
    """A word_table() as an Arrow stream, which is what tasks get."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as to:
        to.write_table(table, 8192)
    return out.getvalue().to_pybytes()


def unpacked(table: bytes, pieces: Pieces) -> dict[str, bytes]:
    """The ids of each word of a packed() table, 32 bits each."""
    out = {}
    for b in pa.ipc.open_stream(table):
        ends, flat = b.column(1).offsets.to_numpy().tolist(), b.column(1).values.to_numpy()
        for k, word in enumerate(b.column(0).to_pylist()):
            ids = flat[ends[k] : ends[k + 1]]
            if len(ids) and ids.min() < 0:
                ids = np.array([x for i in ids.tolist() for x in ([i] if i >= 0 else pieces.ids(word[-1 - i]))])
            out[word] = ids.astype("<i4").tobytes()
    return out


def reads_back(word: str, ids: bytes, pieces: Pieces) -> bool:
    """Whether a word's ids decode to the word's own bytes, marks read as spaces."""
    return b"".join(map(pieces.bytes.__getitem__, np.frombuffer(ids, "<i4").tolist())) == word.replace(MARK, " ").encode("utf-8", "replace")


class Words(dict):
    """The word table; a word that is not in it goes through the same merges here, and a bounded number of those is kept.

    exact: every word so far reads back. Ids decode to the bytes of the words one after
    another, so a text of such words decodes to itself (but for marks) without a try.
    """

    def __init__(self, table: dict[str, bytes], pieces: Pieces):
        super().__init__(table)
        self.pieces, self.room = pieces, KEPT
        self.exact = all(reads_back(word, ids, pieces) for word, ids in table.items())

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.pieces.merge(word), "<i4").tobytes()
        self.exact = self.exact and reads_back(word, ids, self.pieces)
        if self.room:
            self.room -= 1
            self[word] = ids
        return ids


_WORDS: dict[str, Words] = {}


def _kept(token: str, table, pieces: Pieces) -> Words:
    """The words of one encoding run, kept by the worker from task to task; another run's go."""
    if token not in _WORDS:
        _WORDS.clear()
        _WORDS[token] = Words(unpacked(table.value, pieces), pieces)
    return _WORDS[token]


def decode(ids: np.ndarray, pieces: Pieces) -> str:
    """The text of ids: pieces and bytes joined, without the first space."""
    raw = b"".join(map(pieces.bytes.__getitem__, ids.tolist()))
    return raw[raw[:1] == b" " :].decode("utf-8", "replace")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, table: int = TABLE, keep: list[str] | None = None) -> DataFrame:
    """(id, kept columns, ids, n_tokens, round_trip): the model's ids of every whole text.

    Words that the lattice table has are looked up, the rest merged on the spot: the same
    ids either way, so the table's bound changes no result. round_trip: decoding gives
    the text again (with ▁ in it, which the format itself reads as a space, it does not).
    Null and empty texts: no ids, round_trip true. Repeated rows: a row each. Empty
    input: empty output. The kept columns follow id; one named like a column of the result is an error.
    """
    if clash := {"id", "ids", "n_tokens", "round_trip", "_text"} & set(keep or []):
        raise ValueError(f"kept columns clash with the result's: {sorted(clash)}")
    token = uuid.uuid4().hex
    given = docs.sparkSession.sparkContext.broadcast(packed(word_table(docs, text_col, model, table)))
    shipped = docs.sparkSession.sparkContext.broadcast(Path(model).read_bytes())  # workers need no file of their own
    cols = [F.col(f"`{c}`") for c in keep or []]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *cols, F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = of_bytes(shipped.value)
        words, find = _kept(token, given, pieces), re.compile(pieces.word_pattern()).findall
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                b = big.slice(at, 1024)
                parts, same = [], []
                for t in b.column(b.num_columns - 1):
                    text = t.as_py() or ""
                    ids = b"".join(map(words.__getitem__, find(marked(text))))
                    parts.append(ids)
                    same.append(MARK not in text if words.exact else decode(np.frombuffer(ids, "<i4"), pieces) == text)
                n = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(parts), "<i4"))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(n), pa.array(same, pa.bool_())], names=[*b.schema.names[:-1], "ids", "n_tokens", "round_trip"])

    schema = rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("round_trip", T.BooleanType())
    return rows.mapInArrow(run, schema)
