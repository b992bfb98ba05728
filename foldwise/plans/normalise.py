"""Normalisation, pooling, profiles, imputation."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from foldwise.operators import normalise as no
from foldwise.operators import reshape as rs
from foldwise.plans import inputs as i
from foldwise.plans.registry import fragment, query
from foldwise.plans.reshape import SAMPLES, fractions, profiles
from foldwise.session import bounded, staged

POOL = {"AUTOMOBILE": "goods", "BUILDING": "goods", "FURNITURE": "home", "HOUSEHOLD": "Other", "MACHINERY": "Other"}
_POOL_SQL = "CASE WHEN grp IN ('AUTOMOBILE', 'BUILDING') THEN 'goods' WHEN grp = 'FURNITURE' THEN 'home' ELSE 'Other' END"


@query("E12", "SELECT grp, sample_id, sum(value) AS value FROM decon GROUP BY ALL", "decon")
def pooled_sums(spark, sf):
    return no.pooled_sums(i.deconvoluted(spark, sf), ["grp", "sample_id"])


@query("E13", f"""SELECT feature_id, pooled AS grp, round(CASE WHEN pooled = 'Other' THEN sum(s / n) ELSE sum(s) / sum(n) END, 6) AS value
FROM (SELECT feature_id, grp, {_POOL_SQL} AS pooled, sum(value) AS s, count(value) AS n FROM decon GROUP BY ALL) GROUP BY feature_id, pooled""", "decon")
def baseline_profiles(spark, sf):
    return i.rounded(no.baseline_profiles(i.deconvoluted(spark, sf), POOL), "value")


@query("E14", "SELECT p_brand, sample_id, round(avg(value), 6) AS value FROM bulk JOIN part ON p_partkey = feature_id GROUP BY ALL", "bulk")
def mean_by_key(spark, sf):
    part = i.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), "p_brand")
    return i.rounded(no.mean_by_key(i.bulk(spark, sf).join(part, "feature_id"), ["p_brand", "sample_id"]), "value")


fragment("factors", """SELECT sample_id, coalesce(nullif(quantile_cont(value / ref, 0.5), 0), 1) AS factor FROM bulk
JOIN (SELECT feature_id, exp(avg(ln(nullif(value, 0)))) AS ref FROM bulk GROUP BY feature_id) USING (feature_id) GROUP BY sample_id""", "bulk")


@query("E20", "SELECT sample_id, round(factor, 6) AS factor FROM factors", "factors")
def size_factors(spark, sf):
    return i.rounded(no.size_factors(i.bulk(spark, sf)), "factor")


@query("E20", "SELECT feature_id, sample_id, round(value / factor, 6) AS value FROM bulk JOIN factors USING (sample_id)", "bulk factors")
def median_of_ratios(spark, sf):
    return i.rounded(no.median_of_ratios(i.bulk(spark, sf)), "value").select("feature_id", "sample_id", "value")


fragment("cpm", "SELECT *, value / coalesce(nullif(sum(value) OVER (PARTITION BY grp, sample_id), 0), 1) * 1e6 AS v FROM expression", "expression")
fragment("zscored", """SELECT grp, sample_id, condition, gene, (v - avg(v) OVER w) / CASE WHEN stddev_samp(v) OVER w = 0 THEN 1 ELSE stddev_samp(v) OVER w END AS value
FROM cpm WINDOW w AS (PARTITION BY grp, gene)""", "cpm")


def scaled_expression(spark, sf):
    return no.zscore(no.cpm(i.expression(spark, sf)), ["grp", "gene"])


@query("E21", "SELECT grp, sample_id, gene, round(v, 6) AS value FROM cpm", "cpm")
def counts_per_million(spark, sf):
    return i.rounded(no.cpm(i.expression(spark, sf)), "value").select("grp", "sample_id", "gene", "value")


@query("E22", "SELECT grp, sample_id, gene, round(value, 6) + 0 AS value FROM zscored", "zscored")
def scaled_expression_table(spark, sf):
    return i.rounded(scaled_expression(spark, sf), "value").select("grp", "sample_id", "gene", "value")


fragment("means", "SELECT feature_id, avg(value) AS mean_value FROM bulk GROUP BY feature_id", "bulk")
fragment("strata", """SELECT feature_id, mean_value, ((mean_value >= e[1] - 1e-9)::INT + (mean_value >= e[2] - 1e-9)::INT + (mean_value >= e[3] - 1e-9)::INT)::INTEGER AS stratum
FROM means, (SELECT quantile_cont(mean_value, [0.25, 0.5, 0.75]) AS e FROM means)""", "means")


def strata(spark, sf):
    return no.intensity_strata(i.bulk(spark, sf).groupBy("feature_id").agg(F.avg("value").alias("mean_value")), "mean_value")


@query("E23", "SELECT feature_id, round(mean_value, 6) AS mean_value, stratum FROM strata", "strata")
def intensity_strata(spark, sf):
    return i.rounded(strata(spark, sf), "mean_value")


@query("E24", """SELECT grp, m.condition, round(avg(abs(m.m - c.m)), 6) AS score FROM (SELECT grp, gene, condition, avg(value) AS m FROM zscored GROUP BY ALL) m
JOIN (SELECT grp, gene, avg(value) AS m FROM zscored WHERE condition = 'C' GROUP BY ALL) c USING (grp, gene) WHERE m.condition <> 'C' GROUP BY ALL""", "zscored")
def condition_variation(spark, sf):
    return i.rounded(no.condition_variation(scaled_expression(spark, sf), "C"), "score")


def gene_edges(spark, sf):
    """A feature's upstream genes: those of its own brand, for parts of even size."""
    part = i.table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("feature_id"), "p_brand")
    genes = i.table(spark, sf, "part").select("p_brand", F.concat_ws("-", "p_brand", "p_type").alias("gene")).distinct()
    return part.join(genes, "p_brand").select("feature_id", "gene")


def opposing_genes(spark, sf):
    return i.expression(spark, sf).where(F.col("gene").endswith("-PROMO")).select("gene").distinct()


def covariate_parts(spark, sf):
    """The gene list of every feature, and the covariate of every gene list."""
    parts = cache(lambda: no.covariate_by_genes(gene_edges(spark, sf), scaled_expression(spark, sf), opposing_genes(spark, sf)))
    return staged(spark, ("gene_lists", sf), lambda: parts()[0]), staged(spark, ("list_covariate", sf), lambda: parts()[1])


def covariate(spark, sf):
    features, values = covariate_parts(spark, sf)
    return features.join(bounded(values), "genes").select("feature_id", "grp", "sample_id", "r")


fragment("gene_edges", """SELECT DISTINCT a.p_partkey AS feature_id, b.p_brand || '-' || b.p_type AS gene FROM part a JOIN part b USING (p_brand) WHERE a.p_size % 2 = 0""")
fragment("covariate", """SELECT feature_id, grp, sample_id, f - coalesce(a, 0) AS r FROM (SELECT feature_id, grp, sample_id, avg(value) AS f FROM gene_edges JOIN zscored USING (gene) GROUP BY ALL)
LEFT JOIN (SELECT grp, sample_id, avg(value) AS a FROM zscored WHERE gene LIKE '%-PROMO' GROUP BY ALL) USING (grp, sample_id)""", "gene_edges zscored")


@query("E25", "SELECT feature_id, grp, sample_id, round(r, 6) + 0 AS r FROM covariate", "covariate")
def expression_covariate(spark, sf):
    return i.rounded(covariate(spark, sf), "r")


def gappy(spark, sf):
    """Every (feature, sample) cell, missing ones null."""
    return rs.densify(i.bulk(spark, sf).select("feature_id", "sample_id", "value"), ["feature_id"], {"sample_id": SAMPLES}, {})


fragment("gappy", "SELECT feature_id, sample_id, value FROM (SELECT DISTINCT feature_id FROM bulk) CROSS JOIN (SELECT sample_id FROM samples) LEFT JOIN (SELECT feature_id, sample_id, value FROM bulk) USING (feature_id, sample_id)", "bulk samples")


@query("E27", """SELECT feature_id, sample_id, value IS NULL AS missing, round(coalesce(value, avg(value) OVER (PARTITION BY feature_id), 0), 6) AS value FROM gappy""", "gappy")
def imputed_features(spark, sf):
    return i.rounded(no.impute_feature_mean(gappy(spark, sf)), "value")


@query("E28", """SELECT count(DISTINCT feature_id) AS n_rows, count(DISTINCT sample_id) AS n_samples, count(DISTINCT grp) AS n_groups, count(*) FILTER (v IS NULL) AS n_missing,
  round(min(v), 6) AS min_value, round(max(v), 6) AS max_value FROM (SELECT p.feature_id, f.sample_id, p.grp, CASE WHEN b.value IS NOT NULL THEN p.value * f.fraction END AS v
  FROM profiles p JOIN fractions f USING (grp) LEFT JOIN bulk b ON b.feature_id = p.feature_id AND b.sample_id = f.sample_id)""", "profiles fractions bulk")
def export_status(spark, sf):
    df = rs.contributions(profiles(spark, sf), fractions(spark, sf), i.bulk(spark, sf))
    return i.rounded(no.export_status(df), "min_value", "max_value")


@query("E36", """SELECT sample_id, min(value) AS min_value, max(value) AS max_value, round(avg(value), 6) AS mean_value, count(*) AS n, count(*) FILTER (value = 0) AS n_zero,
  count(*) - count(value) AS n_missing, round(count(*) FILTER (value <> 0) / count(*), 6) AS nonzero_share FROM gappy GROUP BY sample_id""", "gappy")
def data_summary(spark, sf):
    return i.rounded(no.summarise(gappy(spark, sf), ["sample_id"], "value"), "mean_value", "nonzero_share")


@query("E36", """SELECT grp, round(quantile_cont(r, 0.5), 6) + 0 AS median, round(quantile_cont(r, 0.25), 6) + 0 AS q25, round(quantile_cont(r, 0.75), 6) + 0 AS q75,
  round(min(r), 6) AS min_value, round(max(r), 6) AS max_value, count(r) AS n, count(*) FILTER (abs(r) > 1e-6) AS n_nonzero FROM covariate GROUP BY grp""", "covariate")
def covariate_summary(spark, sf):
    return i.rounded(no.spread_summary(covariate(spark, sf), ["grp"], "r"), "median", "q25", "q75", "min_value", "max_value")
