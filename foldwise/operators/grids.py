"""Counts at every cell of a grid of thresholds, from one look at each row.

A row is a hit of a cell (pct, max_p, min_lff) if it has that pct, p <= max_p and |lff| >= min_lff.
So on the two axes of a pct a row has a place, the first max_p and the last min_lff that let it
through, and is a hit of all cells above the one and below the other.  Rows are counted by place,
and a running sum along either axis gives the count at every cell.

For distinct keys, the cells of a key are those of any of its rows: below a staircase.  Its steps
as +1 at their corners and -1 where neighbouring steps overlap give, by the same running sums, 1 at
every cell of the staircase, so keys are counted without looking at cells.  Where a key has to
be hit in several ways, its staircases are intersected step by step first.

The work is rows plus cells, not rows times cells; what is shuffled by key is at most one entry for
each place that a key has.  A grid is a DataFrame (pct, max_p, min_lff) or a list of such triples;
cells are counted over all combinations of a pct's own thresholds and then looked up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.session import bounded

CELL = ["pct", "max_p", "min_lff"]


def grid_of(spark: SparkSession, grid: DataFrame | Sequence[tuple[float, float, float]]) -> DataFrame:
    """The grid as a DataFrame of distinct cells."""
    if not isinstance(grid, DataFrame):
        grid = spark.createDataFrame([tuple(map(float, g)) for g in grid], "pct double, max_p double, min_lff double")
    return grid.select(*[F.col(c).cast("double") for c in CELL]).distinct()


def _axes(cells: DataFrame) -> DataFrame:
    """For each pct of a grid its thresholds in ascending order; worked out once for each grid."""
    if not hasattr(cells, "_foldwise_axes"):
        rows = cells.groupBy("pct").agg(F.sort_array(F.collect_set("max_p")).alias("_ps"), F.sort_array(F.collect_set("min_lff")).alias("_ls"))
        cells._foldwise_axes = bounded(rows)
    return cells._foldwise_axes


def placed(results: DataFrame, grid: DataFrame, p_col: str) -> DataFrame:
    """Rows that are a hit of any cell, with their places ``_i`` and ``_j`` and the axes of their pct."""
    rows = results.where(F.col(p_col).isNotNull() & F.col("lff").isNotNull()).withColumn("pct", F.col("pct").cast("double")).join(_axes(grid), "pct")
    rows = rows.withColumn("_i", F.size(F.filter("_ps", lambda x: x < F.col(p_col)))).withColumn("_j", F.size(F.filter("_ls", lambda x: x <= F.abs("lff"))) - 1)
    return rows.where((F.col("_i") < F.size("_ps")) & (F.col("_j") >= 0))


def hits(results: DataFrame, grid: DataFrame | Sequence, p_col: str = "adj_p") -> DataFrame:
    """Each row with each cell it is a hit of: only these cells are made."""
    cells = grid_of(results.sparkSession, grid)
    rows = placed(results, cells, p_col)
    rows = rows.withColumn("max_p", F.explode(F.expr("slice(_ps, _i + 1, size(_ps))"))).withColumn("min_lff", F.explode(F.expr("slice(_ls, 1, _j + 1)")))
    return rows.select(*results.columns, "max_p", "min_lff").join(bounded(cells), CELL, "left_semi")


def at_cells(grid: DataFrame, places: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``sums`` at every cell of the grid from (pct, _i, _j, sums): added up over places up to the cell on both axes."""
    dense = _axes(grid).select("pct", F.posexplode("_ps").alias("_i", "max_p"), "_ls").select("pct", "_i", "max_p", F.posexplode("_ls").alias("_j", "min_lff"))
    dense = dense.join(places, ["pct", "_i", "_j"], "left").fillna(0, list(sums))
    along = Window.partitionBy("pct", "_j").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("pct", "_i").orderBy(F.desc("_j")).rowsBetween(Window.unboundedPreceding, 0)
    for window in (along, down):
        dense = dense.withColumns({c: F.sum(c).over(window) for c in sums})
    return grid.join(dense.select(*CELL, *sums), CELL, "left")


def row_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """How many placed rows of each place fulfil each flag."""
    return rows.groupBy("pct", "_i", "_j").agg(*[F.count_if(flag).alias(name) for name, flag in flags.items()])


def _ledge(places: str) -> str:
    """For each place on the first axis the farthest one on the second that a key's places reach there; -1 for none."""
    return f"transform(sequence(0, _width - 1), i -> coalesce(array_max(transform(filter({places}, x -> x._i <= i), x -> x._j)), -1))"


def key_counts(rows: DataFrame, keys: Sequence[str], counts: dict[str, Sequence[Column]]) -> DataFrame:
    """Places of distinct keys: ``counts`` names, for each count, flags that some hit of the key has to fulfil, each flag its own."""
    flags = [flag for some in counts.values() for flag in some]
    place = F.struct("_i", "_j")
    sets = [F.collect_set(F.when(flag, place)).alias(f"_s{k}") for k, flag in enumerate(flags)]
    held = rows.groupBy("pct", *keys).agg(F.first(F.size("_ps")).alias("_width"), *sets)
    held = held.select("pct", *[F.expr(_ledge(f"_s{k}")).alias(f"_g{k}") for k in range(len(flags))])
    steps, at = [], 0
    for name, some in counts.items():
        reach = f"_g{at}"
        for k in range(at + 1, at + len(some)):
            reach = f"zip_with({reach}, _g{k}, (x, y) -> least(x, y))"
        at += len(some)
        held = held.withColumn(f"_r_{name}", F.expr(reach))
        own = [(F.col("sign") if other == name else F.lit(0)).alias(other) for other in counts]
        before = f"coalesce(get(_r_{name}, i - 1), -1)"
        corners = f"array(named_struct('_i', i, '_j', g, 'sign', 1), named_struct('_i', i, '_j', {before}, 'sign', -1))"
        step = f"flatten(transform(_r_{name}, (g, i) -> filter({corners}, x -> g > {before} AND x._j >= 0)))"
        steps.append(held.select("pct", F.inline(F.expr(step))).select("pct", "_i", "_j", *own))
    places = steps[0]
    for more in steps[1:]:
        places = places.unionByName(more)
    return places.groupBy("pct", "_i", "_j").agg(*[F.sum(name).alias(name) for name in counts])
