"""Epochs of training batches, and rows cut into numbered runs by a fold over each group.

An epoch deals fragments (files, ranges of a file, any bounded piece) to ranks, shuffles
them by seed, joins a few of them to a table, sorts a table's rows by length and cuts them
into batches whose order is shuffled again. A table is a few fragments, so a task holds
what a trainer would hold; nothing grows with the corpus but the list of fragments (one
row each: 100 TB in fragments of 128 MB are 800,000).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def element_length(df: DataFrame, column: str) -> Column:
    """Length of each value of a column: elements of arrays and maps, characters of strings, bytes of binaries; null is 0."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ArrayType, T.MapType)):
        n = F.size(column)
    elif isinstance(kind, T.StringType):
        n = F.length(column)
    elif isinstance(kind, T.BinaryType):
        n = F.octet_length(column)
    else:
        raise TypeError(f"{column} of {kind.simpleString()} has no length")
    return F.when(F.col(column).isNull(), 0).otherwise(n).cast("int")


def digest(seed: int, *parts: Column) -> Column:
    """Hexadecimal MD5 of seed:part:part..., a hash that any engine has."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"))


def token_bounds(lengths: Column, most: int, keep_long: bool = False) -> Column:
    """[(from, to)] of the batches of an ascending array of lengths, one fold over it.

    At place i a cut falls before place i - 1 once lengths[i] times the i - from rows behind
    it is over `most`. The last batch goes if the greatest length alone is over `most`
    (keep_long: it stays). Empty batches are left out.
    """
    none = F.expr("cast(array() as array<int>)")
    first = F.struct(F.lit(0).alias("i"), F.lit(0).alias("at"), none.alias("cuts"))

    def step(s: Column, n: Column) -> Column:
        cut = n.cast("long") * (s["i"] - s["at"]) > most
        at = F.when(cut, s["i"] - 1).otherwise(s["at"])
        return F.struct((s["i"] + 1).alias("i"), at.alias("at"), F.when(cut, F.concat(s["cuts"], F.array(at))).otherwise(s["cuts"]).alias("cuts"))

    whole = F.lit(keep_long) | (F.coalesce(F.get(lengths, F.size(lengths) - 1), F.lit(0)) <= most)
    ends = F.aggregate(lengths, first, step, lambda s: F.when(whole, F.concat(s["cuts"], F.array(s["i"]))).otherwise(s["cuts"]))
    return F.filter(between(ends), lambda b: b["from"] < b["to"])


def between(ends: Column) -> Column:
    """[(from, to)] of the runs that end at the given places, the first from 0."""
    # bound in an array of one, so that the ends are worked out once
    runs = lambda e: F.transform(e, lambda to, k: F.struct(F.coalesce(F.get(e, k - 1), F.lit(0)).alias("from"), to.alias("to")))
    return F.transform(F.array(ends), runs)[0]


def fixed_bounds(n: Column, size: int) -> Column:
    """[(from, to)] of batches of `size` rows, the last one of what is left."""
    return F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.struct(i.alias("from"), F.least(i + size, n).alias("to")))


def thousandth(lengths: Column) -> Column:
    """Floor of the 0.001 quantile (between two places in proportion) of ascending whole numbers, in whole numbers: in floating point it may fall just short of one."""
    last = F.size(lengths) - 1
    low = F.floor(last / 1000).cast("int")
    at = lambda i: F.coalesce(F.get(lengths, i), F.lit(0)).cast("long")
    return F.floor((at(low) * (1000 - last % 1000) + at(low + 1) * (last % 1000)) / 1000)


def fragments(df: DataFrame, fragment: str, ranks: int, together: int, seed: int) -> DataFrame:
    """(fragment, rank, step): ranks take equal runs of the fragments in their order; a rank's are shuffled by seed, `together` of them make a step's table."""
    named = df.select(fragment).distinct()
    place = F.row_number().over(Window.orderBy(fragment)) - 1
    dealt = named.withColumn("rank", F.floor(place * ranks / F.count("*").over(Window.partitionBy())).cast("int"))
    shuffled = F.row_number().over(Window.partitionBy("rank").orderBy(digest(seed, F.col(fragment)), fragment)) - 1
    return dealt.withColumn("step", F.floor(shuffled / together).cast("int"))


def epoch(
    df: DataFrame,
    fragment: str,
    key: str,
    *,
    batch_size: int | None = None,
    max_tokens: int | None = None,
    length: str | None = None,
    min_rows: int = 0,
    rank: int | None = None,
    ranks: int = 1,
    together: int = 10,
    seed: int = 0,
    keep_long: bool = False,
) -> DataFrame:
    """df's rows with rank, step, batch and at: one epoch, read in the order of (step, batch, at) by each rank.

    Give batch_size (rows) or max_tokens (padded length, by the column `length`). Rows of a
    step are sorted by length plus a small number by seed (below the greater of 2 and the
    length's 0.001 quantile), so that other seeds make other neighbours; without `length`
    they are in random order. Batches of fewer than min_rows rows go. rank: that rank's
    rows only. key: a column that tells rows apart; equal seeds give equal epochs.
    Columns must be orderable (no maps) and not be named like the four that are added.
    """
    if (batch_size is None) == (max_tokens is None):
        raise ValueError("give batch_size or max_tokens")
    if max_tokens is not None and length is None:
        raise ValueError("max_tokens needs a column to measure")
    if clash := {"rank", "step", "batch", "at"} & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} are added by epoch()")
    plan = fragments(df, fragment, ranks, together, seed)
    if rank is not None:
        plan = plan.where(F.col("rank") == rank)
    names = [F.col(c) for c in df.columns]
    h = digest(seed, F.col(key))
    row = F.struct((element_length(df, length) if length else F.lit(0)).alias("n"), h.alias("h"), F.struct(*names).alias("row"))
    marked = df.select(F.col(fragment).alias("_fragment"), row.alias("r"))
    step = marked.join(plan, F.col("_fragment").eqNullSafe(plan[fragment])).groupBy("rank", "step")
    tables = step.agg(F.collect_list("r").alias("rows"), F.sort_array(F.collect_list("r.n")).alias("lengths"))
    jitter = lambda x: F.pmod(F.conv(F.substring(x["h"], 1, 8), 16, 10).cast("long"), F.col("spread")) if length else F.lit(0)
    placed = lambda x: F.struct((x["n"] + jitter(x)).cast("int").alias("n"), x["h"].alias("h"), x["row"].alias("row"))
    tables = tables.withColumn("spread", F.greatest(F.lit(2), thousandth(F.col("lengths"))))
    tables = tables.select("rank", "step", F.sort_array(F.transform("rows", placed)).alias("rows"))
    bounds = fixed_bounds(F.size("rows"), batch_size) if batch_size else token_bounds(F.col("rows.n"), max_tokens, keep_long)
    bounds = F.filter(bounds, lambda b: b["to"] - b["from"] >= min_rows)
    shuffled = F.sort_array(F.transform(bounds, lambda b: F.struct(digest(seed, b["from"]).alias("h"), b["from"].alias("from"), b["to"].alias("to"))))
    batches = tables.select("rank", "step", "rows", F.posexplode(shuffled).alias("batch", "b"))
    rows = batches.select("rank", "step", "batch", F.posexplode(F.slice("rows", F.col("b.from") + 1, F.col("b.to") - F.col("b.from"))).alias("at", "r"))
    return rows.select("r.row.*", "rank", "step", "batch", "at")


def numbered_runs(df: DataFrame, keys: list[str], order: list[str], ends: Callable[[Column], Column], name: str) -> DataFrame:
    """df with the number of the run that each row of a group is in, from 0.

    ends: from a group's rows in order (an array of structs) to the places at which its
    runs end, ascending. A group's rows are held together: a recording, a part of a table.
    """
    row = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.struct(*df.columns).alias("row"))
    groups = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    runs = groups.select("rows", F.posexplode(between(ends(F.col("rows.row")))).alias(name, "b"))
    return runs.select(name, F.explode(F.slice("rows.row", F.col("b.from") + 1, F.col("b.to") - F.col("b.from"))).alias("r")).select("r.*", name)


def run_ends(rows: Column, starts: Callable[[Column, Column], tuple[Column, Column]], state: Column) -> Column:
    """Places at which runs end, the last one included: starts(state, row) gives the next state and whether a run starts at the row.

    The state has a field i, the row's place, which is kept here; the first row never ends a run.
    """
    first = F.struct(F.lit(0).alias("i"), state.alias("s"), F.expr("cast(array() as array<int>)").alias("ends"))

    def step(acc: Column, row: Column) -> Column:
        after, cut = starts(F.struct(acc["i"].alias("i"), acc["s"].alias("s")), row)
        cut = F.coalesce(cut, F.lit(False)) & (acc["i"] > 0)
        return F.struct((acc["i"] + 1).alias("i"), after.alias("s"), F.when(cut, F.concat(acc["ends"], F.array(acc["i"]))).otherwise(acc["ends"]).alias("ends"))

    return F.aggregate(rows, first, step, lambda acc: F.concat(acc["ends"], F.array(acc["i"])))


def capped_ends(duration: str, fresh: Callable[[Column], Column], may: Callable[[Column], Column], cap: float) -> Callable[[Column], Column]:
    """Ends for numbered_runs(): a run starts where `fresh` says so, and at a row of `may` once the duration summed since
    the last such cut has reached the cap. The first row's duration does not count; null ones are zero."""

    def starts(s: Column, row: Column) -> tuple[Column, Column]:
        total = F.when(s["i"] == 0, F.lit(0.0)).otherwise(s["s"] + F.coalesce(row[duration].cast("double"), F.lit(0.0)))
        cut = (total >= cap) & may(row) & (s["i"] > 0)
        return F.when(cut, F.lit(0.0)).otherwise(total), F.coalesce(fresh(row), F.lit(False)) | F.coalesce(cut, F.lit(False))

    return lambda rows: run_ends(rows, starts, F.lit(0.0))


def padded_ends(length: str, most: int) -> Callable[[Column], Column]:
    """Ends for numbered_runs() of rows in order of length: the greatest length times the rows of a run stays within `most`; one row at least a run."""

    def starts(s: Column, row: Column) -> tuple[Column, Column]:
        cut = F.coalesce(row[length].cast("long") * (s["i"] - s["s"] + 1) > most, F.lit(False)) & (s["i"] > s["s"])
        return F.when(cut, s["i"]).otherwise(s["s"]), cut

    return lambda rows: run_ends(rows, starts, F.lit(0))
