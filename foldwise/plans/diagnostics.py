"""Diagnostics of data, design and labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from foldwise.operators import diagnostics as di
from foldwise.operators import reshape as rs
from foldwise.operators import stats as st
from foldwise.plans import inputs as i
from foldwise.plans import tails
from foldwise.plans.normalise import covariate, covariate_parts, gappy
from foldwise.plans.registry import fragment, query
from foldwise.plans.reshape import SAMPLES, fractions, profiles
from foldwise.plans.sampling import sample_totals
from foldwise.session import bounded, staged

POWER = 1.5
POWERS = [1.0 + 0.05 * k for k in range(21)]


def intensity_cells(spark, sf):
    """Every (feature, sample) with its expected and observed value."""
    mu = di.mixed_mean(profiles(spark, sf), fractions(spark, sf))
    return staged(spark, ("intensity", sf), lambda: gappy(spark, sf).join(mu, ["feature_id", "sample_id"], "left"))


fragment("mu", "SELECT feature_id, sample_id, sum(value * fraction) AS mu FROM profiles JOIN fractions USING (grp) GROUP BY ALL", "profiles fractions")
fragment("intensity", "SELECT feature_id, sample_id, value, mu FROM gappy LEFT JOIN mu USING (feature_id, sample_id)", "gappy mu")


_EDGES = ", ".join(f"{float(e)!r}::DOUBLE" for e in np.linspace(0, 1, 21))


@query("E32", f"""SELECT condition, b::INTEGER AS bin, round(b / 20.0, 6)::DOUBLE AS low, count(p) AS n, round(any_value(e) / 20, 6) AS expected
FROM (SELECT condition, count(*) AS e FROM results GROUP BY condition) CROSS JOIN range(20) r(b)
LEFT JOIN (SELECT condition, least(19, len(list_filter([{_EDGES}], lambda e: e <= round(p, 6))) - 1) AS b, p FROM results) USING (condition, b) GROUP BY condition, b""", "results")
def p_value_histogram(spark, sf):
    rows = i.rounded(i.results(spark, sf), "p")
    return i.rounded(di.histogram(rows, ["condition"], "p", 0.0, 1.0, 20), "low", "expected")


@query("E33", """SELECT b::INTEGER AS bin, count(*) AS n, round(avg((value IS NULL)::INT), 6) AS dropout, round(any_value(lo) + (b + 0.5) * any_value(hi - lo) / 50, 6) AS centre
FROM (SELECT *, greatest(0, least(49, floor((x - lo) / ((hi - lo) / 50)))) AS b FROM (SELECT value, log10(mu) AS x FROM intensity WHERE mu > 0),
  (SELECT quantile_cont(log10(mu), 0.01) AS lo, quantile_cont(log10(mu), 0.99) AS hi FROM intensity WHERE mu > 0)) GROUP BY b HAVING count(*) >= 50""", "intensity")
def dropout_by_intensity(spark, sf):
    return i.rounded(di.dropout_by_intensity(intensity_cells(spark, sf)), "dropout", "centre")


fragment("mean_variance", "SELECT feature_id, avg(value) AS mean, var_samp(value) AS variance, count(*) AS n FROM bulk WHERE value > 0 GROUP BY feature_id HAVING count(*) >= 3 AND var_samp(value) > 0", "bulk")


@query("E34", "SELECT feature_id, round(mean, 6) AS mean, round(variance, 6) AS variance, n FROM mean_variance", "mean_variance")
def mean_variance(spark, sf):
    return i.rounded(di.mean_variance(i.bulk(spark, sf), 3), "mean", "variance")


@query("E34 H11", """SELECT round(regr_slope(log10(variance), log10(mean)), 6) AS slope, round(regr_intercept(log10(variance), log10(mean)), 6) AS intercept,
  round(regr_r2(log10(variance), log10(mean)), 6) AS r2, count(*) AS n FROM mean_variance""", "mean_variance")
def variance_power_law(spark, sf):
    return i.rounded(di.power_law(i.bulk(spark, sf), 3), "slope", "intercept", "r2")


@query("E35", f"""SELECT b::INTEGER AS bin, count(*) AS n, round(stddev_pop(value - mean), 6) AS sd_raw, round(stddev_pop((value - mean) / sqrt(pow(mean, {POWER}))), 6) AS sd_scaled
FROM (SELECT *, greatest(0, least(23, floor((log10(mean) - lo) / ((hi - lo) / 24)))) AS b FROM (SELECT value, mean FROM bulk JOIN pos USING (feature_id) WHERE value > 0),
  (SELECT min(log10(mean)) AS lo, max(log10(mean)) AS hi FROM pos)) GROUP BY b HAVING count(*) > 10""", "bulk pos")
def residual_spread(spark, sf):
    return i.rounded(di.residual_spread(i.bulk(spark, sf), POWER), "sd_raw", "sd_scaled")


fragment("pos", "SELECT feature_id, avg(value) AS mean FROM bulk WHERE value > 0 GROUP BY feature_id HAVING count(*) >= 3", "bulk")
fragment("residuals", f"""SELECT feature_id, sample_id, family, residual FROM (SELECT *, g / nullif(stddev_samp(g) OVER w, 0) AS constant, t / nullif(stddev_samp(t) OVER w, 0) AS power, count(*) OVER w AS n
  FROM (SELECT *, value - mu AS g, (value - mu) / pow(mu, {POWER / 2}) AS t FROM intensity WHERE value > 0 AND mu > 0) WINDOW w AS (PARTITION BY feature_id))
UNPIVOT (residual FOR family IN (constant, power)) WHERE n >= 10""", "intensity")


@query("H12", """SELECT family, count(*) AS n, round(any_value(m3) / pow(any_value(m2), 1.5), 6) AS skew, round(any_value(m4) / pow(any_value(m2), 2) - 3, 6) AS excess_kurtosis
FROM (SELECT *, avg(pow(d, 2)) OVER w AS m2, avg(pow(d, 3)) OVER w AS m3, avg(pow(d, 4)) OVER w AS m4 FROM (SELECT family, residual - avg(residual) OVER (PARTITION BY family) AS d FROM residuals)
  WINDOW w AS (PARTITION BY family)) GROUP BY family""", "residuals")
def residual_moments(spark, sf):
    return i.rounded(st.moments(di.standardised_residuals(intensity_cells(spark, sf), POWER), ["family"], "residual"), "skew", "excess_kurtosis")


@query("F9", f"""SELECT rank, round({tails.normal_quantile('((rank - 0.5) / m)')}, 6) + 0 AS theoretical, round(residual, 6) + 0 AS observed
FROM (SELECT residual, row_number() OVER (ORDER BY residual) AS rank, count(*) OVER () AS m FROM residuals WHERE family = 'power')""", "residuals")
def normal_qq(spark, sf):
    rows = di.standardised_residuals(intensity_cells(spark, sf), POWER).where("family = 'power'").withColumn("id", F.concat_ws(":", "feature_id", "sample_id"))
    return i.rounded(di.normal_qq(rows, "residual", "id"), "theoretical", "observed")


@query("E38", """SELECT p AS power, round(quantile_cont(variance / pow(mean, p), 0.5), 6) AS median_chi2 FROM (SELECT avg(value) AS mean, var_samp(value) AS variance FROM bulk WHERE value > 0 GROUP BY feature_id HAVING count(*) >= 10)
CROSS JOIN (VALUES """ + ", ".join(f"({p!r}::DOUBLE)" for p in POWERS) + ") v(p) GROUP BY p", "bulk")
def chi2_calibration(spark, sf):
    return i.rounded(di.chi2_calibration(i.bulk(spark, sf), POWERS), "median_chi2")


def feature_dropout(spark, sf):
    return intensity_cells(spark, sf).groupBy("feature_id").agg(F.round(F.avg("mu"), 9).alias("mean_value"), F.count_if(F.col("value").isNull()).alias("n_missing"))


_WALK = ", ".join(f"('{pick}', {k}, {p!r}::DOUBLE)" for pick in di.PICKS for k, p in enumerate(di.pick_walk(pick)))


@query("E39", f"""SELECT pick, arg_min(feature_id, o) AS feature_id, round(arg_min(mean_value, o), 6) AS mean_value, arg_min(n_missing, o) AS n_missing FROM (
  SELECT *, CASE WHEN ok THEN step ELSE 1000 END AS o FROM (SELECT *, CASE pick WHEN 'high' THEN n_missing = 0 WHEN 'medium' THEN n_missing BETWEEN 3 AND 8 ELSE n_missing >= 8 END AS ok
    FROM (SELECT *, row_number() OVER (ORDER BY mean_value, feature_id) - 1 AS r, count(*) OVER () AS total FROM
      (SELECT feature_id, round(avg(mu), 9) AS mean_value, count(*) FILTER (value IS NULL) AS n_missing FROM intensity GROUP BY feature_id))
    JOIN (VALUES {_WALK}) w(pick, step, share) ON r = CAST(floor(total * share) AS BIGINT)) WHERE ok OR step = 0) GROUP BY pick""", "intensity")
def representative_features(spark, sf):
    return i.rounded(di.representative_features(feature_dropout(spark, sf)), "mean_value")


@query("E29", "SELECT grp, gene, round(avg(value), 6) + 0 AS mean FROM cpm_rows GROUP BY ALL", "cpm_rows")
def profile_means(spark, sf):
    return i.rounded(di.profile_means(i.expression(spark, sf)), "mean")


fragment("cpm_rows", "SELECT grp, sample_id, gene, value FROM expression", "expression")


@query("E29", """SELECT grp, a.gene AS gene_a, b.gene AS gene_b, round(covar_samp(a.v, b.v), 4) + 0 AS covariance FROM dense a JOIN dense b USING (grp, sample_id) WHERE a.gene <= b.gene GROUP BY ALL""", "dense")
def profile_covariance(spark, sf):
    return di.profile_covariance(i.expression(spark, sf), SAMPLES).withColumn("covariance", F.round("covariance", 4) + F.lit(0.0))


fragment("dense", "SELECT grp, gene, sample_id, coalesce(value, 0) AS v FROM (SELECT DISTINCT grp, gene FROM expression) CROSS JOIN (SELECT sample_id FROM samples) LEFT JOIN (SELECT grp, gene, sample_id, value FROM expression) USING (grp, gene, sample_id)", "expression samples")
fragment("decon_means", "SELECT feature_id, grp, condition, avg(value) AS m FROM decon GROUP BY ALL", "decon")


@query("E30", """SELECT feature_id, grp, a.condition, round(log2(greatest(a.m, 1e-10) / greatest(c.m, 1e-10)), 6) + 0 AS lfc FROM decon_means a
JOIN (SELECT feature_id, grp, m FROM decon_means WHERE condition = 'C') c USING (feature_id, grp) WHERE a.condition <> 'C'""", "decon_means")
def condition_lfc(spark, sf):
    return i.rounded(di.condition_lfc(i.deconvoluted(spark, sf), "C"), "lfc")


@query("E31", """SELECT feature_id, 'all' AS grp, a.condition, round(a.m - c.m, 6) + 0 AS difference FROM complete a JOIN (SELECT feature_id, m FROM complete WHERE condition = 'C') c USING (feature_id) WHERE a.condition <> 'C'""", "complete")
def naive_lfc(spark, sf):
    return i.rounded(di.naive_lfc(i.plain(spark, sf).withColumn("grp", F.lit("all")), "C", 12), "difference")


fragment("complete", "SELECT feature_id, condition, avg(value) AS m FROM plain WHERE feature_id IN (SELECT feature_id FROM plain GROUP BY feature_id HAVING count(value) = 12) GROUP BY ALL", "plain")


def kruskal_sql(by: str, group: str, source: str) -> str:
    """Kruskal-Wallis of ``value`` over ``group`` within ``by`` (one column)."""
    return f"""SELECT {by}, n, n_groups, round(h, 6) AS h, round({tails.chi2_upper("greatest(h, 0)", "(n_groups - 1)")}, 6) AS p FROM (SELECT {by}, sum(m)::BIGINT AS n, count(*) AS n_groups, (12.0 / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1)) / (1 - any_value(ties) / (pow(sum(m), 3) - sum(m))) AS h
FROM (SELECT {by}, {group}, sum(r) AS s, count(*) AS m FROM (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY value) + (count(*) OVER (PARTITION BY {by}, value) - 1) / 2 AS r FROM {source}) GROUP BY ALL)
JOIN (SELECT {by}, sum(pow(t, 3) - t) AS ties FROM (SELECT {by}, value, count(*) AS t FROM {source} GROUP BY ALL) GROUP BY {by}) USING ({by}) GROUP BY {by})"""


@query("H10", kruskal_sql("timepoint", "condition", "bulk"), "bulk")
def kruskal_by_timepoint(spark, sf):
    return i.rounded(st.kruskal(i.bulk(spark, sf), ["timepoint"], "condition", "value"), "h", "p")


# Factors of two to eleven levels, whose groups of order lines are compared.
FACTORS = ["l_linestatus", "l_returnflag", "l_linenumber", "l_discount"]
fragment("factor_lines", " UNION ALL ".join(f"SELECT '{c}' AS factor, {c}::VARCHAR AS level, l_extendedprice::DOUBLE AS value FROM lineitem" for c in FACTORS))


@query("H10", kruskal_sql("factor", "level", "factor_lines"), "factor_lines")
def kruskal_by_factor(spark, sf):
    """Prices compared over the levels of several factors, which differ in how many levels they have."""
    lines = i.table(spark, sf, "lineitem")
    levels = F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in FACTORS]))
    rows = lines.select(F.col("l_extendedprice").cast("double").alias("value"), levels)
    return i.rounded(st.kruskal(rows, ["factor"], "level", "value"), "h", "p")


@query("H11", "SELECT condition, round(regr_slope(value, fg), 6) AS slope, round(regr_intercept(value, fg), 6) AS intercept, round(regr_r2(value, fg), 6) AS r2, count(*) AS n FROM (SELECT p.condition, p.value, c.value AS fg FROM plain p JOIN plain c ON p.feature_id = c.feature_id AND p.timepoint = c.timepoint AND c.condition = 'C' WHERE p.condition <> 'C') GROUP BY condition", "plain")
def condition_lines(spark, sf):
    control = i.plain(spark, sf).where("condition = 'C'").select("feature_id", "timepoint", F.col("value").alias("fg"))
    rows = i.plain(spark, sf).where("condition <> 'C'").join(control, ["feature_id", "timepoint"])
    return i.rounded(st.linear_fit(rows, ["condition"], "fg", "value"), "slope", "intercept", "r2")


@query("H13", """SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sum(a.d * b.d), 3) + 0 AS product FROM centred a JOIN centred b USING (feature_id)
JOIN sample_order oa ON oa.s = a.sample_id JOIN sample_order ob ON ob.s = b.sample_id WHERE oa.k <= ob.k GROUP BY ALL""", "centred sample_order")
def sample_products(spark, sf):
    gram = di.sample_gram(i.bulk(spark, sf), SAMPLES, "value")
    return gram.withColumn("product", F.round("product", 3) + F.lit(0.0))


fragment("centred", "SELECT feature_id, sample_id, v - avg(v) OVER (PARTITION BY feature_id) AS d FROM (SELECT feature_id, sample_id, coalesce(value, 0) AS v FROM gappy)", "gappy")
fragment("sample_order", "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {k})" for k, s in enumerate(SAMPLES)) + ") v(s, k)")


@query("H13")
def sample_pca(spark, sf):
    return di.sample_pca(i.bulk(spark, sf), SAMPLES, "value")


@query("H13", "SELECT s AS sample_id, c::INTEGER AS component, 0.0::DOUBLE AS residual, 0.0::DOUBLE AS share_gap FROM sample_order CROSS JOIN (VALUES (1), (2)) v(c)", "sample_order")
def pca_equations(spark, sf):
    """Products times scores minus scores times their own square sum, and the variance share against the trace: all 0."""
    gram, scores = di.sample_gram(i.bulk(spark, sf), SAMPLES, "value"), di.sample_pca(i.bulk(spark, sf), SAMPLES, "value")
    other = gram.where("sample_a <> sample_b").select(F.col("sample_b").alias("sample_a"), F.col("sample_a").alias("sample_b"), "product")
    whole = gram.unionByName(other)
    trace = gram.where("sample_a = sample_b").agg(F.sum("product")).first()[0]
    size = scores.groupBy("component").agg(F.sum(F.col("score") ** 2).alias("own"), F.first("variance_share").alias("share"))
    turned = whole.join(scores.select(F.col("sample_id").alias("sample_b"), "component", "score"), "sample_b").groupBy("sample_a", "component").agg(F.sum(F.col("product") * F.col("score")).alias("turned"))
    rows = turned.join(size, "component").join(scores.select(F.col("sample_id").alias("sample_a"), "component", "score"), ["sample_a", "component"])
    zero = lambda c: F.round(c, 6) + F.lit(0.0)
    return rows.select(F.col("sample_a").alias("sample_id"), "component", zero((F.col("turned") - F.col("own") * F.col("score")) / F.lit(trace)).alias("residual"),
                       zero(F.col("share") - F.col("own") / F.lit(trace)).alias("share_gap"))


ESTIMATED = i.GROUPS[:-1]


def factor_samples(spark, sf):
    """Samples with their 2x2 indicators and block indicators."""
    rows = i.bulk(spark, sf).select("sample_id", "gender", "timepoint", "condition").distinct()
    one = lambda c, v: F.when(F.col(c) == v, 1.0).otherwise(0.0)
    return rs.factorial_columns(rows).withColumns({"female": one("gender", "F"), "time2": one("timepoint", "t2"), "time3": one("timepoint", "t3")})


def vif_design(spark, sf):
    """x0, x1, x2 per (estimated group, sample)."""
    rows = fractions(spark, sf).where(F.col("grp").isin(ESTIMATED)).join(factor_samples(spark, sf), "sample_id")
    return rows.select("grp", "sample_id", *[(F.col("fraction") * F.col(c)).alias(f"x{k}") for k, c in enumerate(("first", "second", "both"))])


fragment("vif_design", """SELECT grp, sample_id, fraction * (condition IN ('T1', 'T12'))::INT AS x0, fraction * (condition IN ('T2', 'T12'))::INT AS x1, fraction * (condition = 'T12')::INT AS x2
FROM fractions JOIN samples USING (sample_id) WHERE grp <> 'MACHINERY'""", "fractions samples")
fragment("vif_gram", """SELECT *, g00 * (g11 * g22 - g12 * g12) - g01 * (g01 * g22 - g12 * g02) + g02 * (g01 * g12 - g11 * g02) AS det FROM (
  SELECT grp, sum(x0 * x0) + 1e-10 AS g00, sum(x0 * x1) AS g01, sum(x0 * x2) AS g02, sum(x1 * x1) + 1e-10 AS g11, sum(x1 * x2) AS g12, sum(x2 * x2) + 1e-10 AS g22 FROM vif_design GROUP BY grp)""", "vif_design")
fragment("vif", """SELECT feature_id, CASE WHEN sum(q) = 0 OR sum(q) - pow(sum(s), 2) / 96 < 1e-15 THEN 1 ELSE 1 / (1 - least(1 - 1e-10, 1 - (sum(q) - sum(e)) / (sum(q) - pow(sum(s), 2) / 96))) END AS vif FROM (
  SELECT feature_id, s, q, (b0 * b0 * (g11 * g22 - g12 * g12) + b1 * b1 * (g00 * g22 - g02 * g02) + b2 * b2 * (g00 * g11 - g01 * g01)
    + 2 * (b0 * b1 * (g02 * g12 - g01 * g22) + b0 * b2 * (g01 * g12 - g02 * g11) + b1 * b2 * (g02 * g01 - g00 * g12))) / det AS e
  FROM (SELECT feature_id, grp, sum(r * x0) AS b0, sum(r * x1) AS b1, sum(r * x2) AS b2, sum(r) AS s, sum(r * r) AS q FROM covariate JOIN vif_design USING (grp, sample_id) GROUP BY ALL)
  JOIN vif_gram USING (grp)) GROUP BY feature_id""", "covariate vif_design vif_gram")


def feature_vif(spark, sf):
    """Features with the same upstream genes have the same covariate, so each gene list is worked out once."""
    features, values = covariate_parts(spark, sf)
    lists = values.where(F.col("grp").isin(ESTIMATED)).withColumnRenamed("genes", "feature_id")
    vif = di.covariate_vif(lists, vif_design(spark, sf), len(ESTIMATED) * len(SAMPLES)).withColumnRenamed("feature_id", "genes")
    return features.join(bounded(vif), "genes").select("feature_id", "vif")


@query("H14", "SELECT feature_id, round(vif, 6) AS vif FROM vif", "vif")
def covariate_vif(spark, sf):
    return i.rounded(feature_vif(spark, sf), "vif")


@query("H14", "SELECT 'covariate collinearity' AS name, avg((vif < 10)::INT) >= 0.9 AS passed, round(avg((vif < 10)::INT), 6) AS value, round(quantile_cont(vif, 0.5), 6) AS median_vif, round(max(vif), 6) AS max_vif FROM vif", "vif")
def vif_report(spark, sf):
    return i.rounded(di.vif_report(feature_vif(spark, sf)), "value", "median_vif", "max_vif")


@query("H15")
def design_diagnostics(spark, sf):
    return di.design_diagnostics(fractions(spark, sf), factor_samples(spark, sf), i.GROUPS, ESTIMATED)


fragment("wide_fractions", "SELECT sample_id, " + ", ".join(f"max(fraction) FILTER (grp = '{g}') AS \"{g}\"" for g in i.GROUPS) + " FROM fractions GROUP BY sample_id", "fractions")


@query("H15", " UNION ALL ".join(
    f"SELECT {x}::INTEGER AS i, {y}::INTEGER AS j, round(sum(\"{a}\" * \"{b}\"), 6) AS product FROM wide_fractions" for x, a in enumerate(i.GROUPS) for y, b in enumerate(i.GROUPS) if x <= y), "wide_fractions")
def composition_products(spark, sf):
    frame, _, _ = di.design_frame(fractions(spark, sf), factor_samples(spark, sf), i.GROUPS, ESTIMATED)
    return i.rounded(di.gram_sums(frame, i.GROUPS), "product")


@query("H16", """SELECT grp, count(*) AS n_pairs, round(quantile_cont(abs(c), 0.5), 6) AS median_abs, round(avg((abs(c) > 0.7)::INT), 6) AS share_high FROM (
  SELECT a.grp, corr(a.r, b.r) AS c FROM picked a JOIN picked b ON a.grp = b.grp AND a.sample_id = b.sample_id AND a.feature_id < b.feature_id GROUP BY a.grp, a.feature_id, b.feature_id) GROUP BY grp""", "picked")
def pairwise_correlation(spark, sf):
    return i.rounded(di.pairwise_feature_corr(covariate(spark, sf), SAMPLES, 2000), "median_abs", "share_high")


fragment("picked", """SELECT grp, feature_id, sample_id, coalesce(c.r, 0) AS r FROM (SELECT feature_id FROM (SELECT DISTINCT feature_id FROM covariate) ORDER BY md5(feature_id || ':42'), feature_id LIMIT 2000)
CROSS JOIN (SELECT DISTINCT grp FROM covariate) CROSS JOIN (SELECT sample_id FROM samples) LEFT JOIN covariate c USING (grp, feature_id, sample_id)""", "covariate samples")


@query("H18", """SELECT position::INTEGER AS position, name, status FROM (VALUES (0, 'covariate collinearity', CASE WHEN (SELECT avg((vif < 10)::INT) >= 0.9 FROM vif) THEN 'PASS' ELSE 'FAIL' END),
  (1, 'fractions', 'PASS'), (2, 'dropout', 'INFO'), (3, 'permutation null', 'NOT RUN')) v(position, name, status)""", "vif")
def gate_report(spark, sf):
    vif = di.vif_report(feature_vif(spark, sf)).select("name", "passed")
    sums = fractions(spark, sf).groupBy("sample_id").agg(F.sum("fraction").alias("t")).agg(F.bool_and(F.abs(F.col("t") - 1) < 1e-4).alias("passed"))
    checks = vif.unionByName(sums.withColumn("name", F.lit("fractions")))
    info = feature_dropout(spark, sf).agg(F.lit("dropout").alias("name"), F.when(F.count(F.lit(1)) < 0, True).alias("passed"))
    return di.gate_report(checks.unionByName(info), ["covariate collinearity", "fractions", "dropout", "permutation null"])


@query("H18", """SELECT bool_and(passed) AS all_passed, count(*) FILTER (NOT passed) AS n_blocking FROM (SELECT avg((vif < 10)::INT) >= 0.9 AS passed FROM vif
UNION ALL SELECT bool_and(abs(t - 1) < 1e-4) FROM (SELECT sum(fraction) AS t FROM fractions GROUP BY sample_id) UNION ALL SELECT count(*) >= 25 FROM samples)""", "vif fractions samples")
def gate_outcome(spark, sf):
    """The verdict over three checks; 24 samples fail the last one."""
    vif = di.vif_report(feature_vif(spark, sf)).select("name", "passed")
    sums = fractions(spark, sf).groupBy("sample_id").agg(F.sum("fraction").alias("t")).agg(F.bool_and(F.abs(F.col("t") - 1) < 1e-4).alias("passed"))
    many = factor_samples(spark, sf).agg((F.count(F.lit(1)) >= 25).alias("passed"))
    return di.gate_outcome(vif.unionByName(sums.withColumn("name", F.lit("fractions"))).unionByName(many.withColumn("name", F.lit("samples"))))


@query("H19 F14", """SELECT sample_id, gender, condition, inferred_gender, inferred_condition, inferred_gender <> gender OR inferred_condition <> condition AS mismatch FROM (
  SELECT *, CASE WHEN female > male THEN 'F' ELSE 'O' END AS inferred_gender, CASE WHEN a AND b THEN 'T12' WHEN a THEN 'T1' WHEN b THEN 'T2' ELSE 'C' END AS inferred_condition FROM (
    SELECT *, row_number() OVER (ORDER BY first DESC, sample_id) <= 12 AS a, row_number() OVER (ORDER BY second DESC, sample_id) <= 12 AS b FROM sample_totals))""", "sample_totals")
def label_validation(spark, sf):
    return di.validate_labels(sample_totals(spark, sf))


fragment("lib_sizes", "SELECT sample_id, grp, sum(value) AS value FROM decon GROUP BY ALL", "decon")
fragment("cell_counts", "SELECT sample_id, grp, count(*)::DOUBLE AS value FROM decon GROUP BY ALL", "decon")


@query("H20", """SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, round(sum(pow(a.z - b.z, 2)), 6) AS distance
FROM (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10) AS z FROM lib_sizes WINDOW w AS (PARTITION BY grp)) a
JOIN (SELECT *, (value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-10) AS z FROM cell_counts WINDOW w AS (PARTITION BY grp)) b USING (grp) GROUP BY ALL""", "lib_sizes cell_counts")
def fingerprint_distance(spark, sf):
    by = i.deconvoluted(spark, sf).groupBy("sample_id", "grp")
    return i.rounded(di.fingerprint_distance(by.agg(F.sum("value").alias("value")), by.agg(F.count(F.lit(1)).cast("double").alias("value"))), "distance")
