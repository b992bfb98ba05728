"""Ranks, running values and percentiles that do not gather a large group in one task.

A window over ``by`` sorts each group inside one task.  That is the best plan while
the largest group is small, so every helper first writes its input, unless it is a
written table already, and checks the largest group there; the input's own plan
runs once.  Beyond the bound, rows are range-partitioned by (by, order): a group
then spans many tasks and its ranks come from each task's row positions plus
per-task offsets.  Where equal values may fill a task, they are first folded into one
row with their count.

Both ways treat a missing key as a key, keep groups without any value, and give the
same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.keys import join_same
from foldwise.session import bounded, materialise, written

GROUP_ROWS = "foldwise.groupRows"
DEFAULT_GROUP_ROWS = 2_000_000
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def group_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(GROUP_ROWS, str(DEFAULT_GROUP_ROWS)))


def sized(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, bool]:
    """``df`` as a written table, and whether its largest group is small enough for one task."""
    kept = written(df)
    sizes = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.agg(F.max("n")).first()[0]
    return kept, (largest or 0) <= group_rows(df)


def ranked(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    name: str = "rank",
    fits: bool | None = None,
) -> DataFrame:
    """Add the 1-based row number of each row within ``by``, exact at any group size.

    ``order`` should tell rows apart: rows equal in all of it share a task.
    """
    by = list(by)
    if fits is None:
        df, fits = sized(df, by)
    if fits:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    keys = [F.col(c) for c in by]
    ordered = materialise(
        df.repartitionByRange(tasks, *keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    ordered = ordered.withColumn("__task", F.shiftright("__at", _LOCAL_BITS)).withColumn(
        "__at", F.col("__at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    # One row per (group, task): a group holds at most one run of rows per task.
    runs = ordered.groupBy(*by, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    return (
        join_same(ordered, bounded(runs), [*by, "__task"])
        .withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1)
        .drop("__at", "__task", "__first", "__before")
    )


def running(
    df: DataFrame,
    by: Sequence[str],
    rank: str,
    value: Column,
    name: str,
    how: str = "sum",
    reverse: bool = False,
    fits: bool | None = None,
) -> DataFrame:
    """Running sum, min or max of ``value`` in ``rank`` order, from either end."""
    by = list(by)
    combine = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    if fits is None:
        df, fits = sized(df, by)

    def upto(keys: list[str], column: str, last: int):
        order = F.col(column).desc() if reverse else F.col(column).asc()
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, last)

    df = df.withColumn("__v", value)
    if fits:
        return df.withColumn(name, combine("__v").over(upto(by, rank, 0))).drop("__v")
    block = F.floor((F.col(rank) - 1) / F.lit(group_rows(df))).cast("long")
    df = df.withColumn("__block", block)
    blocks = df.groupBy(*by, "__block").agg(combine("__v").alias("__total"))
    blocks = blocks.withColumn("__carry", combine("__total").over(upto(by, "__block", -1))).drop("__total")
    within = df.withColumn("__here", combine("__v").over(upto([*by, "__block"], rank, 0)))
    joined = join_same(within, bounded(blocks), [*by, "__block"])
    if how == "sum":
        total = F.col("__here") + F.coalesce("__carry", F.lit(0))
    else:
        total = (F.least if how == "min" else F.greatest)("__here", "__carry")  # both skip nulls
    return joined.withColumn(name, total).drop("__v", "__block", "__here", "__carry")


def _folded(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Each distinct value of a group with how many rows have it (``__n``) and how many up to it (``__upto``)."""
    values = materialise(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n")))
    rows = ranked(values, by, [F.col(value)], "__i", fits=False)
    return running(rows, by, "__i", F.col("__n"), "__upto", fits=False).drop("__i")


def _interpolated(at: Column, low: Column, high: Column) -> Column:
    return low + (high - low) * (at - F.floor(at))


def group_percentiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: dict[str, float],
    extra: Sequence[Column] = (),
    fits: bool | None = None,
) -> DataFrame:
    """Exact linearly interpolated percentiles per group, plus ``extra`` aggregates."""
    by = list(by)
    if not by:
        cuts = [F.lit(v).cast("double").alias(n) for n, v in whole_percentiles(df, value, probs).items()]
        return (df.agg(*extra) if extra else df.sparkSession.range(1).select()).select("*", *cuts)
    if fits is None:
        df, fits = sized(df, by)
    if fits:
        cuts = F.percentile(value, F.array(*[F.lit(float(q)) for q in probs.values()])).alias("__cuts")  # one buffer for all
        rows = df.groupBy(*by).agg(cuts, *extra)
        return rows.select(*by, *[F.col("__cuts")[k].alias(n) for k, n in enumerate(probs)], *rows.columns[len(by) + 1:])
    sizes = df.groupBy(*by).agg(F.count(value).alias("__all"), *extra)
    rows = join_same(_folded(df, by, value), bounded(df.groupBy(*by).agg(F.count(value).alias("__of"))), by)
    aggs = []
    for name, q in probs.items():
        at = (F.col("__of") - 1) * F.lit(float(q))
        within = lambda place: F.max(F.when((F.col("__upto") > place) & (F.col("__upto") - F.col("__n") <= place), F.col(value)))
        aggs.append(_interpolated(F.max(at), within(F.floor(at)), within(F.ceil(at))).alias(name))
    return join_same(sizes, rows.groupBy(*by).agg(*aggs), by, "left").drop("__all")


_BRACKET_VALUES = 50_000  # distinct values that a scan may bring to the driver
CELLS = 100_000  # histogram cells that a scan may bring to the driver
SKETCH = 10_000  # accuracy of the sketch: ranks are off by rows / SKETCH at most


def _scan(rows: DataFrame) -> list:
    """One pass over the values, folded to a bounded number of rows."""
    return rows.collect()


def whole_percentiles(df: DataFrame, value: str, probs: dict[str, float]) -> dict[str, float | None]:
    """Exact interpolated percentiles of a whole column of finite numbers, without sorting it.

    All wanted ranks are narrowed together, in three scans however many they are: a mergeable sketch
    brackets each, a histogram over the cells of all brackets tells which cell holds which rank, and the
    distinct values of these cells are counted.  Few rows need no sketch, and cells that still hold too
    many distinct values are the brackets of a further histogram.
    """
    known = written(df.select(F.col(value).cast("double").alias("v")).where(F.col(value).isNotNull()))
    wanted = sorted(set(probs.values()))
    ends = [min(max(q + side * 2 / SKETCH, 0.0), 1.0) for q in wanted for side in (-1, 1)]
    sketch = F.percentile_approx("v", F.array(*[F.lit(float(e)) for e in ends]), SKETCH)
    n, low, high, found = _scan(known.agg(F.count(F.lit(1)), F.min("v"), F.max("v"), sketch))[0]
    if not n:
        return dict.fromkeys(probs)
    places = {name: (n - 1) * float(q) for name, q in probs.items()}
    ranks = sorted({r for at in places.values() for r in (math.floor(at), math.ceil(at))})
    values: dict[int, float] = {}
    brackets = _joined([(low, high)] if n <= _BRACKET_VALUES else list(zip(found[::2], found[1::2], strict=True)))
    if n <= _BRACKET_VALUES:
        values = _values_at(known, brackets, {0: 0}, ranks)
    while len(values) < len(ranks):
        open_ranks = [r for r in ranks if r not in values]
        cells = _histogram(known, brackets)
        brackets, before = [], {}
        upto = 0
        for _, count, least, most in cells:
            inside = [r for r in open_ranks if upto <= r < upto + count]
            if inside and least == most:
                values.update(dict.fromkeys(inside, least))
            elif inside:
                before[len(brackets)] = upto
                brackets.append((least, most))
            upto += count
        if brackets:
            values.update(_values_at(known, brackets, before, [r for r in open_ranks if r not in values]))
    return {name: values[math.floor(at)] + (values[math.ceil(at)] - values[math.floor(at)]) * (at - math.floor(at)) for name, at in places.items()}


def _joined(brackets: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Ascending intervals without common values."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(brackets):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _histogram(known: DataFrame, brackets: Sequence[tuple[float, float]]) -> list:
    """``(cell, rows, least, most)`` in ascending order: equal cells of each bracket, and one between two brackets."""
    size = max(64, CELLS // len(brackets))
    v, key = F.col("v"), None
    for k, (low, high) in enumerate(brackets):
        # Halves, so that a width cannot overflow.
        share = (v / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2) if high > low else F.lit(0.0)
        cell = F.lit((2 * k + 1) * size) + F.least(F.floor(share * size), F.lit(size - 1))
        key = (F.when if key is None else key.when)(v < F.lit(low), F.lit(2 * k * size)).when(v <= F.lit(high), cell)
    key = key.otherwise(F.lit(2 * len(brackets) * size)).cast("long")
    return sorted(_scan(known.groupBy(key.alias("cell")).agg(F.count(F.lit(1)), F.min("v"), F.max("v"))))


def _values_at(known: DataFrame, brackets: Sequence[tuple[float, float]], before: dict[int, int], ranks: Sequence[int]) -> dict[int, float]:
    """Values at those of the ranks that lie in the brackets, if these have few distinct values; ``before[k]`` rows are less than bracket k."""
    held = F.lit(False)
    for low, high in brackets:
        held = held | F.col("v").between(low, high)
    rows = _scan(known.where(held).groupBy("v").agg(F.count(F.lit(1)).alias("c")).limit(_BRACKET_VALUES + 1))
    if len(rows) > _BRACKET_VALUES:
        return {}
    out, wanted, k, upto = {}, list(ranks), 0, before[0]
    for v, c in sorted(rows):
        while v > brackets[k][1]:
            k += 1
            upto = before[k]
        out.update({r: v for r in wanted if upto <= r < upto + c})
        upto += c
    return out


def average_ranks(
    df: DataFrame, by: Sequence[str], value: str, name: str, fits: bool | None = None
) -> DataFrame:
    """Ranks with ties sharing their mean rank."""
    by = list(by)
    if fits is None:
        df, fits = sized(df, by)
    if fits:
        order = Window.partitionBy(*by).orderBy(value)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*by, value))
        return df.withColumn(name, F.rank().over(order) + (ties - 1) / 2.0)
    values = materialise(_folded(df, by, value).withColumn(name, F.col("__upto") - (F.col("__n") - 1) / 2.0).drop("__upto"))
    # A value that fills a task is joined by broadcast: there are at most rows / bound of them.
    often = F.col("__n") > group_rows(df)
    hot = bounded(values.where(often).drop("__n"))
    rest = values.where(~often).drop("__n")
    marked = join_same(df, hot, [*by, value], "left")
    return marked.where(F.col(name).isNotNull()).unionByName(join_same(marked.where(F.col(name).isNull()).drop(name), rest, [*by, value]).select(*marked.columns))


def folded_ranks(counts: DataFrame, by: Sequence[str], value: str, n: str, name: str, ties: str) -> DataFrame:
    """Mean ranks of distinct values from rows that each stand for ``n`` equal ones: (by, value, ``ties``, ``name``)."""
    by = list(by)
    values, fits = sized(counts.groupBy(*by, value).agg(F.sum(n).alias(ties)), by)
    rows = ranked(values, by, [F.col(value)], "__i", fits)
    rows = running(rows, by, "__i", F.col(ties), "__upto", fits=fits)
    return materialise(rows.select(*by, value, ties, (F.col("__upto") - (F.col(ties) - 1) / 2.0).alias(name)))
