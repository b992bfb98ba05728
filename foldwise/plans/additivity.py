"""Single versus combined condition, and tests over contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import additivity as ad
from foldwise.operators import stats as st
from foldwise.operators import summaries as su
from foldwise.plans import inputs as i
from foldwise.plans import tails
from foldwise.plans.registry import fragment, query
from foldwise.plans.summaries import with_evidence

T = i.TREATMENTS
_CASE = """CASE WHEN sig_T1 AND NOT sig_T2 AND NOT sig_T12 THEN 'T1_only' WHEN NOT sig_T1 AND sig_T2 AND NOT sig_T12 THEN 'T2_only'
  WHEN NOT sig_T1 AND NOT sig_T2 AND sig_T12 THEN 'T12_only_emergent' WHEN sig_T1 AND sig_T2 AND NOT sig_T12 THEN 'T1+T2_missing_T12'
  WHEN sig_T1 AND NOT sig_T2 AND sig_T12 THEN 'T1+T12' WHEN NOT sig_T1 AND sig_T2 AND sig_T12 THEN 'T2+T12' WHEN sig_T1 AND sig_T2 AND sig_T12 THEN 'all_three' ELSE 'none' END"""
fragment("categories", f"SELECT *, {_CASE} AS category FROM triplets", "triplets")


@query("E15", "SELECT grp, timepoint, " + ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c}\"" for c in ad.categories(T)) + " FROM categories GROUP BY grp, timepoint", "categories")
def overlap_categories(spark, sf):
    return ad.overlap_counts(i.triplets(spark, sf), i.CONTEXT, T)


@query("E15", "SELECT category, count(*) AS n FROM categories WHERE category <> 'none' GROUP BY category", "categories")
def pooled_overlap(spark, sf):
    rows = i.triplets(spark, sf).withColumn("category", ad.overlap_category(T)).where("category <> 'none'")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("E16", """SELECT set_id, count(*) AS n_contexts, CASE WHEN count(*) FILTER (dir_T12 = '+') >= count(*) FILTER (dir_T12 = '-') THEN '+' ELSE '-' END AS direction,
  round(avg(lff_T12), 6) AS mean_lff_T12, round(avg(lff_T1), 6) AS mean_lff_T1, round(avg(lff_T2), 6) AS mean_lff_T2, round(avg(p_T1), 6) AS mean_p_T1, round(avg(p_T2), 6) AS mean_p_T2
FROM categories WHERE category = 'T12_only_emergent' GROUP BY set_id""", "categories")
def emergent_sets(spark, sf):
    return i.rounded(ad.emergent_sets(i.triplets(spark, sf), T), "mean_lff_T12", "mean_lff_T1", "mean_lff_T2", "mean_p_T1", "mean_p_T2")


@query("E16", """SELECT grp, coalesce(sum(n) FILTER (timepoint = 't1'), 0)::BIGINT AS t1, coalesce(sum(n) FILTER (timepoint = 't2'), 0)::BIGINT AS t2, coalesce(sum(n) FILTER (timepoint = 't3'), 0)::BIGINT AS t3
FROM (SELECT grp, timepoint, count(*) AS n FROM categories WHERE category = 'T12_only_emergent' GROUP BY ALL) GROUP BY grp""", "categories")
def emergent_counts(spark, sf):
    return su.hit_counts(ad.emergent_rows(i.triplets(spark, sf), T), ["grp"], "timepoint", i.TIMEPOINTS)


fragment("concordance", """SELECT grp, timepoint, set_id, 'T1' AS compared, dir_T12 AS combined_direction, dir_T1 AS direction, dir_T1 = dir_T12 AS concordant FROM triplets WHERE sig_T12 AND sig_T1
UNION ALL SELECT grp, timepoint, set_id, 'T2', dir_T12, dir_T2, dir_T2 = dir_T12 FROM triplets WHERE sig_T12 AND sig_T2""", "triplets")


@query("E17", "SELECT * FROM concordance", "concordance")
def direction_concordance(spark, sf):
    return ad.direction_concordance(i.triplets(spark, sf), i.CONTEXT, T)


@query("E17", "SELECT count(*) FILTER (concordant) AS n_concordant, count(*) AS n, round(avg(concordant::INT), 6) AS rate FROM concordance", "concordance")
def concordance_rate(spark, sf):
    return i.rounded(ad.concordance_rate(ad.direction_concordance(i.triplets(spark, sf), i.CONTEXT, T)), "rate")


def _spearman(x: str, y: str, by: str, source: str) -> str:
    rank = lambda v: f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0)::DOUBLE"
    return f"SELECT *, {rank(x)} AS rx, {rank(y)} AS ry FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"


fragment("rounded_triplets", "SELECT * REPLACE (round(lff_sum, 6) AS lff_sum, round(lff_T12, 6) AS lff_T12) FROM triplets", "triplets")
fragment("paired", _spearman("lff_sum", "lff_T12", "grp, timepoint", "rounded_triplets"), "rounded_triplets")


@query("E18 C13 H8", f"""SELECT grp, timepoint, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round(mean_residual, 6) AS mean_residual, round(std_residual, 6) AS std_residual,
  round({tails.correlation("pearson", "n")}, 6) AS pearson_p, round({tails.correlation("spearman", "n")}, 6) AS spearman_p
FROM (SELECT grp, timepoint, count(*) AS n, corr(lff_sum, lff_T12) AS pearson, corr(rx, ry) AS spearman FROM paired GROUP BY ALL)
JOIN (SELECT grp, timepoint, avg(lff_residual) AS mean_residual, stddev_samp(lff_residual) AS std_residual FROM triplets GROUP BY ALL) USING (grp, timepoint)""", "paired triplets")
def additivity_stats(spark, sf):
    df = i.rounded(i.triplets(spark, sf), "lff_sum", "lff_T12")
    return i.rounded(ad.additivity_stats(df, i.CONTEXT, "T12"), "pearson", "spearman", "mean_residual", "std_residual", "pearson_p", "spearman_p")


@query("E18 E15", """SELECT timepoint, category, count(*) AS n, round(avg(lff_residual), 6) AS mean_residual FROM categories GROUP BY ALL""", "categories")
def pooled_additivity(spark, sf):
    rows = i.triplets(spark, sf).withColumn("category", ad.overlap_category(T))
    return i.rounded(rows.groupBy("timepoint", "category").agg(F.count(F.lit(1)).alias("n"), F.avg("lff_residual").alias("mean_residual")), "mean_residual")


_EXTREME = "SELECT grp, timepoint, set_id, round(lff_T12, 6) AS lff_T12, round(lff_sum, 6) AS lff_sum, round(lff_residual, 6) AS lff_residual, '{end}' AS \"end\", CASE WHEN lff_residual > 0 THEN 'synergistic' ELSE 'antagonistic' END AS type FROM triplets WHERE lff_residual IS NOT NULL QUALIFY row_number() OVER (PARTITION BY grp, timepoint ORDER BY round(lff_residual, 6) {way}, set_id) <= 5"


@query("F3", f"({_EXTREME.format(end='largest', way='DESC')}) UNION ALL ({_EXTREME.format(end='smallest', way='ASC')})", "triplets")
def extreme_residuals(spark, sf):
    df = i.rounded(ad.extreme_residuals(i.triplets(spark, sf), i.CONTEXT), "lff_T12", "lff_sum", "lff_residual")
    return df.select("grp", "timepoint", "set_id", "lff_T12", "lff_sum", "lff_residual", "end", "type")


fragment("sides", " UNION ALL ".join(f"SELECT grp, timepoint, '{t}' AS condition, lff_{t} AS lff, n_{t} AS n, coalesce(sig_{t}, false) AS sig FROM triplets" for t in T), "triplets")
fragment("ceiling", """SELECT grp, timepoint, condition, count(*) FILTER (sig) AS n_sig, count(*) AS n_tested, 100 * count(*) FILTER (sig) / count(*) AS pct_sig, avg(lff) AS mean_lff, stddev_samp(lff) AS std_lff,
  avg(lff) FILTER (sig) AS mean_lff_sig, max(lff) - min(lff) AS lff_range, quantile_cont(lff, 0.75) - quantile_cont(lff, 0.25) AS lff_iqr, avg(abs(lff)) AS mean_abs_lff,
  avg(n) AS mean_members, quantile_cont(n::DOUBLE, 0.5) AS median_members, coalesce(sum(n), 0)::BIGINT AS total_members, avg(n) FILTER (sig) AS mean_members_sig FROM sides GROUP BY ALL""", "sides")
_CEILING = ["pct_sig", "mean_lff", "std_lff", "mean_lff_sig", "lff_range", "lff_iqr", "mean_abs_lff", "mean_members", "median_members", "mean_members_sig"]


@query("E19", f"SELECT grp, timepoint, condition, n_sig, n_tested, total_members, {', '.join(f'round({c}, 6) AS {c}' for c in _CEILING)} FROM ceiling", "ceiling")
def ceiling_diagnostic(spark, sf):
    return i.rounded(ad.ceiling_diagnostic(i.triplets(spark, sf), i.CONTEXT, T).fillna(0, ["total_members"]), *_CEILING)


@query("E19", """SELECT grp, timepoint, max_diff, round(cv, 6) AS cv, max_diff = 0 AS equal, coalesce(cv < 0.1, false) AS near_equal
FROM (SELECT grp, timepoint, max(n_sig) - min(n_sig) AS max_diff, stddev_samp(n_sig) / nullif(avg(n_sig), 0) AS cv FROM ceiling GROUP BY ALL)""", "ceiling")
def equal_hit_counts(spark, sf):
    return i.rounded(ad.equal_counts(ad.ceiling_diagnostic(i.triplets(spark, sf), i.CONTEXT, T), i.CONTEXT, T), "cv")


fragment("gini_difference", """SELECT grp, timepoint, round(c - (a + b) / 2, 9) AS difference FROM (SELECT grp, timepoint, max(gini) FILTER (condition = 'T1') AS a,
  max(gini) FILTER (condition = 'T2') AS b, max(gini) FILTER (condition = 'T12') AS c FROM gini GROUP BY ALL) WHERE a + b + c IS NOT NULL""", "gini")
_T_TEST = "count(*) AS n, round(avg(difference), 6) AS mean, avg(difference) / (stddev_samp(difference) / sqrt(count(*))) AS t, count(*) FILTER (difference < 0) AS n_negative"


def gini_differences(spark, sf):
    table = su.gini(with_evidence(spark, sf), i.COMPARISON, "e")
    return su.single_versus_combined(table, i.CONTEXT, "gini", T).withColumn("difference", F.round("difference", 9))


_T_P = "round(" + tails.t_two_sided("t", "n - 1") + ", 6) AS t_p"
_W_P = "round(" + tails.signed_rank("w", "n") + ", 6) AS w_p"
fragment("moved", "SELECT *, rank() OVER (PARTITION BY timepoint ORDER BY abs(difference)) AS r, rank() OVER (ORDER BY abs(difference)) AS s FROM gini_difference WHERE difference <> 0", "gini_difference")


@query("H9", f"""SELECT * REPLACE (round(t, 6) AS t), {_T_P}, {_W_P} FROM (SELECT {_T_TEST} FROM gini_difference), (SELECT least(sum(r) FILTER (difference > 0), sum(r) FILTER (difference < 0))::DOUBLE AS w
FROM (SELECT *, row_number() OVER (ORDER BY abs(difference)) AS r FROM gini_difference))""", "gini_difference")
def concentration_tests(spark, sf):
    return i.rounded(st.mean_tests(gini_differences(spark, sf), [], "difference"), "mean", "t", "t_p", "w_p")


@query("H9", f"""SELECT * REPLACE (round(t, 6) AS t), {_T_P}, {_W_P} FROM (SELECT timepoint, {_T_TEST} FROM gini_difference GROUP BY timepoint)
JOIN (SELECT timepoint, least(coalesce(sum(r) FILTER (difference > 0), 0), coalesce(sum(r) FILTER (difference < 0), 0))::DOUBLE AS w FROM moved GROUP BY timepoint) USING (timepoint)""", "gini_difference moved")
def concentration_tests_by_timepoint(spark, sf):
    return i.rounded(st.mean_tests(gini_differences(spark, sf), ["timepoint"], "difference"), "mean", "t", "t_p", "w_p")


@query("H9", f"""SELECT n, round(t, 6) AS t, {_T_P}, w, {_W_P} FROM (SELECT count(*) AS n, avg(difference) / (stddev_samp(difference) / sqrt(count(*))) AS t FROM gini_difference),
(SELECT least(coalesce(sum(s) FILTER (difference > 0), 0), coalesce(sum(s) FILTER (difference < 0), 0))::DOUBLE AS w FROM moved)""", "gini_difference moved")
def concentration_test_p_values(spark, sf):
    tests = st.mean_tests(gini_differences(spark, sf), [], "difference").select("n", "t", "t_p", "w", "w_p")
    return i.rounded(tests, "t", "t_p", "w_p")


@query("H8", f"""SELECT grp, timepoint, n, round(pearson, 6) AS pearson, round(spearman, 6) AS spearman, round({tails.correlation('pearson', 'n')}, 6) AS pearson_p,
  round({tails.correlation('spearman', 'n')}, 6) AS spearman_p FROM (SELECT grp, timepoint, count(*) AS n, corr(lff_sum, lff_T12) AS pearson, corr(rx, ry) AS spearman FROM paired GROUP BY ALL)""", "paired")
def additivity_p_values(spark, sf):
    rows = i.rounded(i.triplets(spark, sf), "lff_sum", "lff_T12")
    return i.rounded(st.correlations(rows, i.CONTEXT, "lff_sum", "lff_T12"), "pearson", "spearman", "pearson_p", "spearman_p")
