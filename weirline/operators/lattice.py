"""Words of texts without spaces: the best path through a lattice of dictionary words."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of dictionary words that are shipped to the tasks at most.
SHIPPED = 64 << 20
#: Letters of a run that are looked at together; longer runs are cut behind a word that every best path has, or here.
WINDOW = 4096

# Ranges of the scripts written without spaces (Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han).
SPACELESS = "฀-໿ༀ-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0002fa1f"
TOKEN = re.compile(rf"(?P<run>[{SPACELESS}]+)|[^\W{SPACELESS}]+|[^\w\s]")


class Lattice:
    """Dictionary words with costs, and the cheapest way to cut a run of letters into them."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.longest = max(map(len, counts), default=1)
        #: A letter that starts no word costs more than any word, so that it is only used where no word fits.
        self.unknown = math.log(total) + 10.0
        self.cut = lru_cache(maxsize=65_536)(self._cut)

    def _cut(self, run: str) -> tuple[str, ...]:
        """The cheapest words of a run; of equally cheap ways that of fewer words, then of the longer last word."""
        best = [(0.0, 0, 0)] + [(math.inf, 0, 0)] * len(run)
        for end in range(1, len(run) + 1):
            for start in range(max(0, end - self.longest), end):
                word = run[start:end]
                price = self.cost.get(word, self.unknown if end - start == 1 else None)
                if price is not None:
                    before = best[start]
                    best[end] = min(best[end], (round(before[0] + price, 9), before[1] + 1, start))
        out, end = [], len(run)
        while end:
            start = best[end][2]
            out.append(run[start:end])
            end = start
        return tuple(reversed(out))

    def words(self, text: str) -> list[str]:
        """Words of runs without spaces by the dictionary, other words and single marks as they stand; white space goes, nothing else."""
        out: list[str] = []
        for m in TOKEN.finditer(text):
            run = m["run"]
            if run is None:
                out.append(m[0])
                continue
            while len(run) > WINDOW:
                part = self.cut(run[:WINDOW])
                keep = part[: max(1, len(part) - 8)]  # the last words may change with what follows
                out += keep
                run = run[sum(map(len, keep)) :]
            out += self.cut(run)
        return out


def dictionary_words(df: DataFrame, text: str, dictionary: DataFrame, out: str = "words") -> DataFrame:
    """df with the words of a text by a dictionary (word, n); a word given twice counts with the sum. Null text: null.

    The dictionary is shipped only if its words are at most SHIPPED bytes; a larger one is an error.
    """
    listed = dictionary.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    size = listed.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    if size > SHIPPED:
        raise ValueError(f"a dictionary of {size} bytes, over {SHIPPED}: drop its rare words")
    shipped = df.sparkSession.sparkContext.broadcast({r.word: r.n for r in listed.collect()})

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(shipped.value)
        for s in batches:
            yield pd.Series([None if t is None else lattice.words(t) for t in s], dtype=object)

    return df.withColumn(out, run(F.col(text)))
