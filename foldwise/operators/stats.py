"""Correlation, location and rank tests, fits and moments over grouped rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.special import chi2_upper, correlation_p, signed_rank_p, t_two_sided
from foldwise.operators.keys import join_same
from foldwise.operators.ordering import average_ranks, folded_ranks, sized
from foldwise.session import materialise

# Below this standard deviation a column counts as constant.
CONSTANT = 1e-10


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of columns without gaps; null (not an error) when one is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation, 0 when either side is constant."""
    flat = (F.stddev_pop(x) < CONSTANT) | (F.stddev_pop(y) < CONSTANT)
    return F.when(flat, F.lit(0.0)).otherwise(pearson(x, y))


def slope_through_origin(x: str, y: str) -> Column:
    """sum(xy) / sum(yy), 0 when the denominator vanishes."""
    squares = F.sum(F.col(y) * F.col(y))
    return F.when(squares < 1e-15, F.lit(0.0)).otherwise(F.try_divide(F.sum(F.col(x) * F.col(y)), squares))


def correlations(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (mean ranks for ties) per group, with two-sided p values."""
    by = list(by)
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows, fits = sized(rows, by)
    rows = average_ranks(average_ranks(rows, by, x, "_rx", fits), by, y, "_ry", fits)
    table = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("pearson"), pearson("_rx", "_ry").alias("spearman"))
    return table.withColumn("pearson_p", correlation_p("pearson", "n")).withColumn("spearman_p", correlation_p("spearman", "n"))


def mean_tests(df: DataFrame, by: Sequence[str], d: str) -> DataFrame:
    """One-sample t test and Wilcoxon signed-rank test of differences against 0.

    Zero differences do not take part in the ranks; ties share their mean rank.
    """
    by = list(by)
    rows = df.where(F.col(d).isNotNull())
    t = F.try_divide(F.avg(d), F.stddev(d) / F.sqrt(F.count(d)))
    table = rows.groupBy(*by).agg(F.count(d).alias("n"), F.avg(d).alias("mean"), t.alias("t"), F.count_if(F.col(d) < 0).alias("n_negative"))
    table = table.withColumn("t_p", F.when(F.col("n") > 1, t_two_sided("t", "n - 1")))
    moved = rows.where(F.col(d) != 0).withColumn("_size", F.abs(d))
    moved = average_ranks(moved, by, "_size", "_rank")
    ties = moved.groupBy(*by, "_size").agg(F.count(F.lit(1)).alias("_t")).groupBy(*by).agg(
        F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    signed = moved.groupBy(*by).agg(
        F.sum(F.when(F.col(d) > 0, F.col("_rank")).otherwise(0.0)).alias("_plus"),
        F.sum(F.when(F.col(d) < 0, F.col("_rank")).otherwise(0.0)).alias("_minus"), F.count(F.lit(1)).alias("_n"))
    signed = (join_same(signed, ties, by) if by else signed.withColumn("_k", F.lit(0)).join(ties.withColumn("_k", F.lit(0)), "_k").drop("_k"))
    signed = signed.withColumn("w", F.least("_plus", "_minus"))
    w_p = signed_rank_p("w", "_n", "_n * (_n + 1) * (2 * _n + 1) / 24 - _ties / 48", "_ties = 0")
    signed = signed.select(*by, "w", w_p.alias("w_p"))
    return join_same(table, signed, by, "left") if by else table.withColumn("_k", F.lit(0)).join(signed.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")


def kruskal(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Kruskal-Wallis H, corrected for ties, with its chi-squared p of one degree of freedom less than there are groups.

    A single group has no p; where all values are equal H has no value either.
    """
    by = list(by)
    # Equal values of a group are one row with a count before anything is ranked or joined.
    counts = materialise(df.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("_n")))
    values = folded_ranks(counts, by, value, "_n", "_rank", "_t")
    ties = values.groupBy(*by).agg(F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    sums = join_same(counts, values, [*by, value]).groupBy(*by, group).agg(F.sum(F.col("_rank") * F.col("_n")).alias("_s"), F.sum("_n").alias("_m"))
    table = sums.groupBy(*by).agg(F.sum(F.col("_s") ** 2 / F.col("_m")).alias("_q"), F.sum("_m").alias("n"), F.count(F.lit(1)).alias("n_groups"))
    table = join_same(table, ties, by)
    n = F.col("n")
    h = F.try_divide(12.0 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1), 1 - F.try_divide(F.col("_ties"), F.pow(n, F.lit(3)) - n))
    return table.select(*by, "n", "n_groups", h.alias("h")).withColumn("p", F.when(F.col("h").isNotNull(), chi2_upper("greatest(h, 0D)", "n_groups - 1")))


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line."""
    return df.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def moments(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Skewness and excess kurtosis (population form)."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skew"), F.kurtosis(value).alias("excess_kurtosis"), F.count(value).alias("n"))
