"""Deterministic sampling, permutation, paging and ordered distinct.

"Random" order is the order of md5(id, seed): the same on every engine and on
every retry of a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.keys import join_same
from foldwise.operators.ordering import ranked
from foldwise.session import bounded, written


def shuffle_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def ordered_distinct(df: DataFrame, key: str, position: str) -> DataFrame:
    """Distinct values with the position of their first occurrence."""
    return df.groupBy(key).agg(F.min(position).alias(position))


def top_n_ties(df: DataFrame, by: Sequence[str], value: str, n: int) -> DataFrame:
    """Rows among the ``n`` largest values, with all ties of the last one."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc())
    return df.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= n).drop("_r")


def top_marker(samples: DataFrame, marker: str, name: str, n: int = 12, tie: str = "sample_id") -> DataFrame:
    """Flag the ``n`` samples with the highest marker value."""
    top = samples.orderBy(F.col(marker).desc(), F.col(tie)).limit(n).select(tie, F.lit(True).alias("_top"))
    return samples.join(top, tie, "left").withColumn(name, F.coalesce("_top", F.lit(False))).drop("_top")


def _first_by_key(df: DataFrame, by: Sequence[str], take: DataFrame, seed: int, key: str) -> DataFrame:
    """The ``_take`` rows of each group that come first in shuffled order, without ordering the others.

    A group's shuffle keys are spread evenly, so nearly all wanted rows lie below a bound worked
    out from its size; only rows below it are ranked.  A group with too few of them, which is
    rare, is ranked as a whole.
    """
    by, df = list(by), written(df)
    want = F.least("_take", "_n")
    bound = F.least((want + 6 * F.sqrt(want) + 20) / F.col("_n"), F.lit(1.0))
    level = F.when(bound >= 1, F.lit("g")).otherwise(F.lpad(F.lower(F.hex(F.floor(bound * float(1 << 32)).cast("long"))), 8, "0"))
    sizes = bounded(take.withColumn("_level", level))
    rows = join_same(df, sizes, by).withColumn("_order", shuffle_key(F.col(key), F.lit(seed)))
    low = written(rows.where(F.substring("_order", 1, 8) < F.col("_level")))
    found = join_same(sizes.select(*by, F.least("_take", "_n").alias("_want")), low.groupBy(*by).agg(F.count(F.lit(1)).alias("_have")), by, "left")
    short = found.where(F.coalesce("_have", F.lit(0)) < F.col("_want")).select(*by)
    if short.limit(1).count():
        few = bounded(short)
        low = written(join_same(low, few, by, "left_anti").unionByName(join_same(rows, few, by, "left_semi")))
    ranks = ranked(low, by, [F.col("_order"), F.col(key)], "_r")
    return ranks.where(F.col("_r") <= F.col("_take")).drop("_r", "_take", "_n", "_level", "_order")


def stratified_sample(df: DataFrame, stratum: str, share: float, least: int, seed: int, key: str = "feature_id") -> DataFrame:
    """A share of each stratum, at least ``least`` rows (a sampling operator): those first in shuffled order."""
    df = written(df)
    take = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).withColumn("_take", F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(least)))
    return _first_by_key(df, [stratum], take, seed, key)


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "feature_id") -> DataFrame:
    """``n`` rows in shuffled order (a sampling operator)."""
    return df.withColumn("_k", shuffle_key(F.col(key), F.lit(seed))).orderBy("_k", key).limit(n).drop("_k")


def restricted_permutation(samples: DataFrame, block: Sequence[str], label: str, seed: int, key: str = "sample_id") -> DataFrame:
    """Permute ``label`` among the rows of each block."""
    block, samples = list(block), written(samples)
    own = ranked(samples, block, [F.col(key)], "_r")
    other = ranked(samples, block, [shuffle_key(F.col(key), F.lit(seed)), F.col(key)], "_r")
    return join_same(own.drop(label), other.select(*block, "_r", label), [*block, "_r"]).drop("_r")


def paginate(df: DataFrame, pages: int, order: Sequence[Column]) -> DataFrame:
    """Near-equal consecutive pages, the first ones larger, numbered from 1."""
    n = df.count()
    size, larger = divmod(n, pages)
    rows = ranked(df, [], order, "_r")
    at = F.col("_r") - 1
    edge = larger * (size + 1)
    late = F.lit(pages) if size == 0 else F.floor((at - edge) / size) + larger + 1
    page = F.when(at < edge, F.floor(at / (size + 1)) + 1).otherwise(late)
    return rows.withColumn("page", page.cast("int")).drop("_r")
