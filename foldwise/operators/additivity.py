"""Single versus combined treatment: overlap, additivity, emergence, concordance, ceilings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators.keys import join_same
from foldwise.operators.ordering import group_percentiles
from foldwise.operators.stats import correlations


def overlap_category(conditions: Sequence[str]) -> Column:
    """Which of the three conditions a set is significant in."""
    one, two, both = conditions
    a, b, x = F.col(f"sig_{one}"), F.col(f"sig_{two}"), F.col(f"sig_{both}")
    return (
        F.when(a & ~b & ~x, f"{one}_only").when(~a & b & ~x, f"{two}_only").when(~a & ~b & x, f"{both}_only_emergent")
        .when(a & b & ~x, f"{one}+{two}_missing_{both}").when(a & ~b & x, f"{one}+{both}").when(~a & b & x, f"{two}+{both}")
        .when(a & b & x, "all_three").otherwise("none")
    )


def categories(conditions: Sequence[str]) -> list[str]:
    one, two, both = conditions
    return [f"{one}_only", f"{two}_only", f"{both}_only_emergent", f"{one}+{two}_missing_{both}", f"{one}+{both}", f"{two}+{both}", "all_three", "none"]


def overlap_counts(triplets: DataFrame, context: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Sets per category and context; a category without sets is 0."""
    rows = triplets.withColumn("_category", overlap_category(conditions))
    names = categories(conditions)
    return rows.groupBy(*context).agg(*[F.count_if(F.col("_category") == n).alias(n) for n in names])


def emergent_rows(triplets: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Sets significant in the combined condition only."""
    one, two, both = conditions
    return triplets.where(F.col(f"sig_{both}") & ~F.col(f"sig_{one}") & ~F.col(f"sig_{two}"))


def emergent_sets(triplets: DataFrame, conditions: Sequence[str]) -> DataFrame:
    one, two, both = conditions
    return emergent_rows(triplets, conditions).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_contexts"), F.mode(f"dir_{both}", True).alias("direction"),
        *[F.avg(f"lff_{c}").alias(f"mean_lff_{c}") for c in (both, one, two)], *[F.avg(f"p_{c}").alias(f"mean_p_{c}") for c in (one, two)])


def direction_concordance(triplets: DataFrame, context: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Per single condition also significant: does its direction match the combined one?"""
    one, two, both = conditions
    sides = F.array(*[F.struct(F.lit(c).alias("compared"), F.col(f"dir_{c}").alias("direction"), F.col(f"sig_{c}").alias("sig")) for c in (one, two)])
    rows = triplets.where(F.col(f"sig_{both}")).withColumn("_s", F.explode(sides)).where("_s.sig")
    return rows.select(*context, "set_id", F.col("_s.compared").alias("compared"), F.col(f"dir_{both}").alias("combined_direction"),
                       F.col("_s.direction").alias("direction"), (F.col("_s.direction") == F.col(f"dir_{both}")).alias("concordant"))


def concordance_rate(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("concordant").alias("n_concordant"), F.count(F.lit(1)).alias("n"), F.avg(F.col("concordant").cast("double")).alias("rate"))


def additivity_stats(triplets: DataFrame, context: Sequence[str], both: str) -> DataFrame:
    """Correlation of the combined effect with the sum of the single ones, and its residual."""
    paired = triplets.where(F.col("lff_sum").isNotNull() & F.col(f"lff_{both}").isNotNull())
    residual = triplets.groupBy(*context).agg(F.avg("lff_residual").alias("mean_residual"), F.stddev("lff_residual").alias("std_residual"))
    return join_same(correlations(paired, context, "lff_sum", f"lff_{both}"), residual, context)


def extreme_residuals(triplets: DataFrame, context: Sequence[str], k: int = 5, tie: str = "set_id") -> DataFrame:
    """The ``k`` largest and ``k`` smallest residuals per context (two top-k windows)."""
    known = triplets.where(F.col("lff_residual").isNotNull())
    value = F.round("lff_residual", 6)

    def top(order: Column, end: str) -> DataFrame:
        w = Window.partitionBy(*context).orderBy(order, F.col(tie))
        return known.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r").withColumn("end", F.lit(end))

    rows = top(value.desc(), "largest").unionByName(top(value.asc(), "smallest"))
    return rows.withColumn("type", F.when(F.col("lff_residual") > 0, "synergistic").otherwise("antagonistic"))


def ceiling_diagnostic(triplets: DataFrame, context: Sequence[str], conditions: Sequence[str]) -> DataFrame:
    """Spread of effects and member counts per (context, condition)."""
    sides = F.array(*[F.struct(F.lit(c).alias("condition"), F.col(f"lff_{c}").alias("lff"), F.col(f"n_{c}").alias("n"), F.col(f"sig_{c}").alias("sig"))
                      for c in conditions])
    rows = triplets.select(*context, F.explode(sides).alias("_s")).select(*context, "_s.*")
    by = [*context, "condition"]
    hit = F.coalesce(F.col("sig"), F.lit(False))
    table = group_percentiles(rows, by, "lff", {"_q1": 0.25, "_q3": 0.75}, [
        F.count_if(hit).alias("n_sig"), F.count(F.lit(1)).alias("n_tested"), F.avg("lff").alias("mean_lff"), F.stddev("lff").alias("std_lff"),
        F.avg(F.when(hit, F.col("lff"))).alias("mean_lff_sig"), (F.max("lff") - F.min("lff")).alias("lff_range"), F.avg(F.abs("lff")).alias("mean_abs_lff"),
        F.avg("n").alias("mean_members"), F.sum("n").alias("total_members"), F.avg(F.when(hit, F.col("n"))).alias("mean_members_sig")])
    medians = group_percentiles(rows.withColumn("_n", F.col("n").cast("double")), by, "_n", {"median_members": 0.5})
    table = join_same(table, medians, by, "left")
    return table.withColumn("pct_sig", 100 * F.col("n_sig") / F.col("n_tested")).withColumn("lff_iqr", F.col("_q3") - F.col("_q1")).drop("_q1", "_q3")


def equal_counts(diagnostic: DataFrame, context: Sequence[str], conditions: Sequence[str], near: float = 0.1) -> DataFrame:
    """Per context: are the hit counts of the conditions equal, or nearly so?"""
    wide = diagnostic.groupBy(*context).agg(
        (F.max("n_sig") - F.min("n_sig")).alias("max_diff"), F.try_divide(F.stddev("n_sig"), F.avg("n_sig")).alias("cv"), F.count(F.lit(1)).alias("_n"))
    wide = wide.where(F.col("_n") == len(conditions)).drop("_n")
    return wide.withColumn("equal", F.col("max_diff") == 0).withColumn("near_equal", F.coalesce(F.col("cv") < near, F.lit(False)))
