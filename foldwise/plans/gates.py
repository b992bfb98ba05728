"""Filters and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import enrichment as en
from foldwise.operators import gates as ga
from foldwise.operators import joins as jo
from foldwise.plans import inputs as i
from foldwise.plans.registry import query
from foldwise.plans.reshape import fractions


@query("A4", "SELECT feature_id, sample_id, value FROM bulk ORDER BY feature_id, sample_id LIMIT 500", "bulk")
def head_rows(spark, sf):
    return ga.head_rows(i.bulk(spark, sf), ["feature_id", "sample_id"], 500).select("feature_id", "sample_id", "value")


@query("C2", """SELECT grp, count(*) AS n FROM decon WHERE grp IN (SELECT grp FROM (SELECT grp, sample_id,
  coalesce(stddev_samp(CASE WHEN grp = 'MACHINERY' THEN 1 ELSE value END), 0) AS sd FROM decon GROUP BY ALL) GROUP BY grp HAVING sum(sd) > 0) GROUP BY grp""", "decon")
def varying_groups(spark, sf):
    flat = i.deconvoluted(spark, sf).withColumn("value", F.when(F.col("grp") == "MACHINERY", 1.0).otherwise(F.col("value")))
    return ga.drop_constant_groups(flat, "grp", "sample_id").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


@query("C3", "SELECT feature_id, count(*) AS n_detected FROM bulk WHERE value > 0 GROUP BY feature_id HAVING count(*) >= 18", "bulk")
def detected_features(spark, sf):
    return ga.detected_features(i.bulk(spark, sf), 18)


@query("C4", """SELECT gene, count(*) AS n_detected FROM (SELECT DISTINCT gene, sample_id FROM expression WHERE value > 0)
GROUP BY gene HAVING count(*) >= 12""", "expression")
def detected_genes(spark, sf):
    return ga.detected_genes(i.expression(spark, sf), 12)


@query("C5", "SELECT grp, timepoint, condition, set_id FROM enriched WHERE abs(lff) >= 0.1 AND p <= 0.101", "enriched")
def significant_sets(spark, sf):
    return i.results(spark, sf).where(en.significant(F.col("p"), F.col("lff"), 0.101, 0.1)).select("grp", "timepoint", "condition", "set_id")


@query("C5", "SELECT grp, timepoint, condition, set_id FROM enriched WHERE p < 0.101", "enriched")
def significant_sets_strict(spark, sf):
    return i.results(spark, sf).where(en.significant_strict(F.col("p"), 0.101)).select("grp", "timepoint", "condition", "set_id")


@query("C6", "SELECT grp, timepoint, condition, set_id, tier FROM results", "results")
def significance_tiers(spark, sf):
    df = i.results(spark, sf).drop("lff_low", "lff_high", "tier")
    return en.significance_tier(df, i.COMPARISON, p_col="p", p_sig=i.P_HIT, p_display=i.P_SHOWN).select("grp", "timepoint", "condition", "set_id", "tier")


@query("C7", "SELECT n_name AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, name LIMIT 10")
def top_groups(spark, sf):
    nation = i.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    sizes = i.table(spark, sf, "customer").join(nation, "c_nationkey").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return ga.top_groups(sizes, "name", "n")


_NOTABLE = f"((lff >= lff_high - 1e-9 OR lff <= lff_low + 1e-9) OR (abs(lff) >= 0.01 AND p <= {i.P_HIT}))"


@query("C8", f"""SELECT grp, timepoint, condition, set_id, CASE WHEN {_NOTABLE} THEN round(lff, 6) END AS lff FROM results
WHERE set_id IN (SELECT set_id FROM results WHERE {_NOTABLE})""", "results")
def notable_rows(spark, sf):
    df = ga.notable_rows(i.results(spark, sf), i.COMPARISON, p_col="p", p_sig=i.P_HIT)
    return i.rounded(df, "lff").select("grp", "timepoint", "condition", "set_id", "lff")


@query("C8", """SELECT grp, timepoint, condition, set_id, CASE WHEN abs(lff) >= 1 AND p <= 0.101 THEN round(lff, 6) END AS lff FROM results
WHERE set_id IN (SELECT set_id FROM results WHERE abs(lff) >= 1 AND p <= 0.101)
  AND (grp, timepoint, condition) IN (SELECT (grp, timepoint, condition) FROM results WHERE abs(lff) >= 1 AND p <= 0.101)""", "results")
def notable_rows_by_threshold(spark, sf):
    df = ga.notable_rows(i.results(spark, sf), i.COMPARISON, p_col="p", p_sig=0.101, lff_min=1.0, tail=None, only_hit_columns=True)
    return i.rounded(df, "lff").select("grp", "timepoint", "condition", "set_id", "lff")


@query("C9", """SELECT g.grp, g.timepoint, g.condition FROM (SELECT DISTINCT grp, timepoint, condition FROM cells WHERE condition <> 'C') g
WHERE EXISTS (SELECT 1 FROM cells c WHERE c.grp = g.grp AND c.timepoint = g.timepoint AND c.condition = 'C')""", "cells")
def available_comparisons(spark, sf):
    grid = jo.comparison_grid(spark, grp=[*i.GROUPS, "NO SUCH GROUP"], timepoint=[*i.TIMEPOINTS, "t4"], condition=i.TREATMENTS)
    return ga.available_comparisons(grid, i.cells(spark, sf), ["grp", "timepoint"], "condition", "C")


@query("C10", "SELECT * FROM plain WHERE feature_id IN (SELECT feature_id FROM plain GROUP BY feature_id HAVING count(value) = 12)", "plain")
def complete_cases(spark, sf):
    return ga.complete_cases(i.plain(spark, sf), 12).select("feature_id", "timepoint", "condition", "value")


@query("C11", "SELECT DISTINCT gene FROM expression WHERE starts_with(gene, 'Brand#1') OR starts_with(gene, 'Brand#22') OR gene IN ('Brand#3-ECONOMY', 'Brand#4-PROMO')", "expression")
def genes_by_prefix(spark, sf):
    return ga.genes_by_prefix(i.expression(spark, sf), ["Brand#1", "Brand#22"], ["Brand#3-ECONOMY", "Brand#4-PROMO"])


@query("C12", "SELECT grp, timepoint, condition, set_id, round(p, 6) AS p FROM sweep_enriched WHERE pct = 10", "sweep_enriched")
def at_threshold(spark, sf):
    return i.rounded(ga.at_threshold(i.sweep(spark, sf), 10.0), "p").select("grp", "timepoint", "condition", "set_id", "p")


@query("C13", "SELECT grp, timepoint, count(*) AS n FROM triplets WHERE lff_sum IS NOT NULL AND lff_T12 IS NOT NULL GROUP BY ALL", "triplets")
def finite_pairs(spark, sf):
    return ga.finite_pairs(i.triplets(spark, sf), "lff_sum", "lff_T12").groupBy("grp", "timepoint").agg(F.count(F.lit(1)).alias("n"))


@query("C14", "SELECT sample_id, abs(sum(fraction) - 1) <= 1e-4 AS passed, round(sum(fraction), 6) AS total FROM fractions GROUP BY sample_id", "fractions")
def checked_fractions(spark, sf):
    return i.rounded(ga.require_fractions(fractions(spark, sf), "sample_id", "fraction"), "total")


@query("C14", "SELECT v.condition FROM (VALUES ('C'), ('T1'), ('T2'), ('T12'), ('T3')) v(condition) WHERE v.condition NOT IN (SELECT condition FROM cells)", "cells")
def missing_labels(spark, sf):
    return ga.missing_labels(i.cells(spark, sf), "condition", ["C", "T1", "T2", "T12", "T3"])
