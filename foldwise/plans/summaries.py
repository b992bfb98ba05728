"""Summary tables, rankings and concentration of the enrichment results."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import corrections as co
from foldwise.operators import enrichment as en
from foldwise.operators import summaries as su
from foldwise.plans import inputs as i
from foldwise.plans.joins import GRID, families
from foldwise.plans.registry import fragment, query
from foldwise.session import staged

KEYS = "grp, timepoint, condition"


@query("E1", f"""SELECT {KEYS}, count(*) FILTER (abs(lff) >= 0.01 AND p <= {i.P_HIT}) AS n_sig, count(*) AS n_tested,
  round(avg(abs(lff)), 6) AS mean_abs_lff FROM results GROUP BY ALL""", "results")
def comparison_summary(spark, sf):
    return i.rounded(su.comparison_summary(i.results(spark, sf), i.COMPARISON, p_col="p", p_sig=i.P_HIT), "mean_abs_lff")


@query("E2", """SELECT set_id, count(*) AS n_sig, round(avg(abs(lff)), 6) AS mean_abs_lff,
  CASE WHEN count(*) FILTER (direction = '+') >= count(*) FILTER (direction = '-') THEN '+' ELSE '-' END AS direction,
  array_to_string(list_sort(list_distinct(list(grp))), ', ') AS groups, round(avg(median_lfc), 6) AS mean_median_lfc,
  coalesce(CASE WHEN m >= s AND m >= w AND m > 0 THEN 'Moderate' WHEN s >= w AND s > 0 THEN 'Strong' WHEN w > 0 THEN 'Subtle' END, 'unknown') AS evidence
FROM hits JOIN (SELECT set_id, count(*) FILTER (evidence = 'Moderate') AS m, count(*) FILTER (evidence = 'Strong') AS s, count(*) FILTER (evidence = 'Subtle') AS w
  FROM hits GROUP BY set_id) USING (set_id) GROUP BY set_id, m, s, w""", "hits")
def set_summary(spark, sf):
    return i.rounded(su.set_summary(i.results(spark, sf)), "mean_abs_lff", "mean_median_lfc")


@query("E3", f"""SELECT {KEYS}, set_id, direction, round(lff, 6) AS lff, round(p, 6) AS p, round(adj_p, 6) AS adj_p, tier, coalesce(n_members, 0) AS n_members,
  round(median_lfc, 6) AS median_lfc, round(q75_lfc, 6) AS q75_lfc, round(max_lfc, 6) AS max_lfc, evidence FROM results""", "results")
def result_table(spark, sf):
    df = su.result_table(i.results(spark, sf), i.COMPARISON).fillna(0, ["n_members"])
    return i.rounded(df, "lff", "p", "adj_p", "median_lfc", "q75_lfc", "max_lfc")


@query("E7 H3", f"""SELECT {KEYS}, set_id, n_members, round(median_lfc, 6) AS median_lfc, round(q75_lfc, 6) AS q75_lfc, round(max_lfc, 6) AS max_lfc
FROM results WHERE p <= {i.P_HIT} AND abs(lff) >= 0.01 AND n_members IS NOT NULL""", "results")
def member_statistics(spark, sf):
    df = en.substrate_stats(i.classes(spark, sf), i.members(spark, sf), i.results(spark, sf), i.COMPARISON, p_col="p", p_sig=i.P_HIT)
    return i.rounded(df, "median_lfc", "q75_lfc", "max_lfc")


@query("H3", f"SELECT {KEYS}, set_id, feature_id, class, round(lfc, 6) AS lfc FROM hit_members", "hit_members")
def enriched_members(spark, sf):
    return i.rounded(en.enriched_members(i.classes(spark, sf), i.members(spark, sf), i.results(spark, sf), i.COMPARISON), "lfc")


def effective(spark, sf) -> float:
    one = staged(spark, ("effective", sf), lambda: spark.createDataFrame([(co.participation(i.members(spark, sf)),)], "meff double"))
    return one.first()[0]


fragment("meff", """SELECT round(n * n / (n + 2 * s), 6) AS meff FROM (SELECT count(DISTINCT set_id)::DOUBLE AS n FROM members)
CROSS JOIN (SELECT coalesce(sum(jaccard * jaccard), 0) AS s FROM pairs)""", "members pairs")


def corrected(spark, sf):
    """Results with a second correction beside the first: the effective number of sets in place of their number."""
    return en.bh_adjust(i.results(spark, sf), i.COMPARISON, "p", "alt_p", m_eff=effective(spark, sf))


fragment("corrected", f"""SELECT * EXCLUDE (r, q), least(1.0, min(q) OVER (PARTITION BY {KEYS} ORDER BY r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS alt_p
FROM (SELECT *, p * (SELECT meff FROM meff) / r AS q FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY p, set_id) AS r FROM results))""", "results meff")


@query("F4", f"SELECT {KEYS}, set_id, round(adj_p, 6) AS adj_p, round(alt_p, 6) AS alt_p FROM corrected", "corrected")
def step_up_correction(spark, sf):
    df = en.bh_adjust(corrected(spark, sf).drop("adj_p"), i.COMPARISON, "p", "adj_p")
    return i.rounded(df, "adj_p", "alt_p").select(*i.COMPARISON, "set_id", "adj_p", "alt_p")


fragment("changes", f"""SELECT *, CASE WHEN abs(lff) >= 0.01 AND alt_p <= 0.201 AND NOT adj_p <= 0.201 THEN 'gained' WHEN abs(lff) >= 0.01 AND adj_p <= 0.201 AND NOT alt_p <= 0.201 THEN 'lost' END AS change
FROM corrected""", "corrected")


@query("E4 G1", f"""SELECT {KEYS}, count(*) FILTER (abs(lff) >= 0.01 AND adj_p <= 0.201) AS n_first, count(*) FILTER (abs(lff) >= 0.01 AND alt_p <= 0.201) AS n_second,
  count(*) FILTER (change = 'gained') AS n_gained, count(*) FILTER (change = 'lost') AS n_lost, count(*) FILTER (change = 'gained') - count(*) FILTER (change = 'lost') AS net_change,
  coalesce(array_to_string((list(set_id ORDER BY set_id) FILTER (change = 'gained'))[1:10], ', '), '') AS gained,
  coalesce(array_to_string((list(set_id ORDER BY set_id) FILTER (change = 'lost'))[1:10], ', '), '') AS lost
FROM changes GROUP BY {KEYS}""", "changes")
def correction_recovery(spark, sf):
    return su.correction_recovery(corrected(spark, sf), i.COMPARISON, "adj_p", "alt_p", 0.201)


@query("E5", """SELECT set_id, count(*) AS n_recovered, array_to_string(list_sort(list_distinct(list(condition))), ', ') AS conditions,
  array_to_string(list_sort(list_distinct(list(timepoint))), ', ') AS timepoints, count(DISTINCT grp) AS n_groups, round(avg(lff), 6) AS mean_lff, round(avg(abs(lff)), 6) AS mean_abs_lff,
  round(avg(p), 6) AS mean_p, round(avg(adj_p), 6) AS mean_first, round(avg(alt_p), 6) AS mean_second FROM changes WHERE change = 'gained' GROUP BY set_id""", "changes")
def recovered_sets(spark, sf):
    df = su.recovered_sets(corrected(spark, sf), "adj_p", "alt_p", 0.201)
    return i.rounded(df, "mean_lff", "mean_abs_lff", "mean_p", "mean_first", "mean_second")


@query("E40", f"""SELECT {KEYS}, set_id, round(-log10(greatest(adj_p, 1e-300)) + 0, 6) AS first_score, round(-log10(greatest(alt_p, 1e-300)), 6) + 0 AS second_score,
  CASE WHEN adj_p <= 0.201 AND alt_p <= 0.201 THEN 'both' WHEN alt_p <= 0.201 THEN 'gained' WHEN adj_p <= 0.201 THEN 'lost' ELSE 'neither' END AS quadrant FROM corrected""", "corrected")
def correction_pairs(spark, sf):
    df = su.correction_pairs(corrected(spark, sf), "adj_p", "alt_p", 0.201)
    return i.rounded(df, "first_score", "second_score").select(*i.COMPARISON, "set_id", "first_score", "second_score", "quadrant")


@query("E6", f"""SELECT condition, timepoint, round(avg(n), 6) AS mean, round(stddev_samp(n) / sqrt(count(*)), 6) AS sem, count(*) AS n
FROM (SELECT {KEYS}, count(*) FILTER (tier = 'significant') AS n FROM results GROUP BY ALL) GROUP BY condition, timepoint""", "results")
def mean_hits(spark, sf):
    counts = i.results(spark, sf).groupBy(*i.COMPARISON).agg(F.count_if(F.col("tier") == "significant").alias("n_hits"))
    return i.rounded(su.mean_sem(counts, ["condition", "timepoint"], "n_hits"), "mean", "sem")


@query("E8", f"SELECT {KEYS}, direction, CASE direction WHEN '-' THEN -c ELSE c END AS n FROM (SELECT {KEYS}, direction, count(DISTINCT set_id) AS c FROM hits GROUP BY ALL)", "hits")
def direction_counts(spark, sf):
    return su.direction_counts(i.results(spark, sf).where("tier = 'significant'"), i.COMPARISON)


@query("E8", """SELECT family, condition, timepoint, direction, CASE direction WHEN '-' THEN -c ELSE c END AS n FROM (SELECT CASE WHEN s_nationkey < 10 THEN 'family_' || s_nationkey ELSE 'Other' END AS family,
  condition, timepoint, direction, count(*) AS c FROM hits JOIN supplier ON s_suppkey = set_id GROUP BY ALL)""", "hits")
def direction_counts_by_family(spark, sf):
    label = F.when(F.col("family") < 10, F.concat(F.lit("family_"), F.col("family").cast("string"))).otherwise("Other")
    rows = i.results(spark, sf).where("tier = 'significant'").join(families(spark, sf), "set_id").withColumn("family", label)
    return su.direction_counts(rows, ["family", "condition", "timepoint"], distinct=False)


@query("E9", """SELECT grp, condition, count(*) FILTER (timepoint = 't1') AS t1, count(*) FILTER (timepoint = 't2') AS t2, count(*) FILTER (timepoint = 't3') AS t3
FROM hits GROUP BY ALL""", "hits")
def hit_counts(spark, sf):
    return su.hit_counts(i.results(spark, sf).where("tier = 'significant'"), ["grp", "condition"], "timepoint", i.TIMEPOINTS)


@query("E10", """SELECT pct, max_p, min_lff, count(set_id) AS total_hits, count(DISTINCT set_id) AS n_sets,
  count(DISTINCT grp || timepoint || condition) AS n_comparisons FROM grid LEFT JOIN refiltered USING (pct, max_p, min_lff) GROUP BY pct, max_p, min_lff""", "grid refiltered")
def threshold_sweep(spark, sf):
    return su.threshold_sweep(i.sweep(spark, sf), GRID, "p")


# Every combination of forty bounds on p and on the factor, all a little beside the round values that rows may have.
FINE, ASIDE = 40, 0.0003
fragment("fine_grid", f"""SELECT pct::DOUBLE AS pct, (a / {FINE}.0)::DOUBLE + {ASIDE}::DOUBLE AS max_p, (b / 16.0)::DOUBLE + {ASIDE}::DOUBLE AS min_lff
FROM (VALUES ({'), ('.join(str(p) for p in i.SWEEP_PCTS)})) v(pct), range(1, {FINE + 1}) r(a), range(0, {FINE}) q(b)""")
fragment("fine_hits", "SELECT s.set_id, grp, timepoint, condition, g.* FROM sweep_enriched s JOIN fine_grid g ON s.pct = g.pct AND s.p <= max_p AND abs(s.lff) >= min_lff", "sweep_enriched fine_grid")


def fine_grid(spark):
    pct = F.explode(F.array(*[F.lit(float(p)) for p in i.SWEEP_PCTS]))
    rows = spark.range(1, FINE + 1).select(pct.alias("pct"), (F.col("id") / float(FINE) + ASIDE).alias("max_p"))
    return rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(FINE - 1)))).withColumn("min_lff", F.col("_b") / 16.0 + ASIDE).drop("_b")


@query("E10", """SELECT pct, max_p, min_lff, count(set_id) AS total_hits, count(DISTINCT set_id) AS n_sets, count(DISTINCT grp || timepoint || condition) AS n_comparisons
FROM fine_grid LEFT JOIN fine_hits USING (pct, max_p, min_lff) GROUP BY pct, max_p, min_lff""", "fine_grid fine_hits")
def fine_threshold_sweep(spark, sf):
    """The sweep over a grid of thousands of cells, which is a table."""
    return su.threshold_sweep(i.sweep(spark, sf), fine_grid(spark), "p")


@query("E11 G2 G3", """SELECT pct, max_p, min_lff, coalesce(n_shared, 0) AS n_shared, coalesce(n_reversed, 0) AS n_reversed, round(pct_down, 6) AS pct_down, round(pct_up, 6) AS pct_up
FROM grid LEFT JOIN (
  SELECT pct, max_p, min_lff, count(*) FILTER (c = 3) AS n_shared, count(*) FILTER (dn AND up) AS n_reversed,
    sum(n_down) / nullif(sum(n_mid), 0) * 100 AS pct_down, sum(n_up) / nullif(sum(n_late), 0) * 100 AS pct_up
  FROM (SELECT pct, max_p, min_lff, set_id, count(DISTINCT condition) FILTER (timepoint = 't2') AS c,
      bool_or(condition = 'T2' AND timepoint = 't2' AND direction = '-') AS dn, bool_or(condition = 'T2' AND timepoint = 't3' AND direction = '+') AS up,
      count(*) FILTER (condition = 'T2' AND timepoint = 't2') AS n_mid, count(*) FILTER (condition = 'T2' AND timepoint = 't2' AND direction = '-') AS n_down,
      count(*) FILTER (condition = 'T2' AND timepoint = 't3') AS n_late, count(*) FILTER (condition = 'T2' AND timepoint = 't3' AND direction = '+') AS n_up
    FROM refiltered GROUP BY ALL) GROUP BY ALL) USING (pct, max_p, min_lff)""", "grid refiltered")
def core_claims(spark, sf):
    return i.rounded(su.core_claims(i.sweep(spark, sf), GRID, i.TREATMENTS, "t2", "t3", "T2", "p"), "pct_down", "pct_up")


@query("E26", """SELECT family, n_sets, round(coalesce(s, 0) / (n_sets * (n_sets - 1) / 2), 6) AS mean_jaccard, round(coalesce(hi, 0), 6) AS max_jaccard,
  round(CASE WHEN coalesce(k, 0) < n_sets * (n_sets - 1) / 2 THEN 0 ELSE lo END, 6) AS min_jaccard, unique_members, total_members, round(1 - unique_members / total_members, 6) AS redundancy
FROM (SELECT s_nationkey AS family, count(DISTINCT set_id) AS n_sets, count(DISTINCT feature_id) AS unique_members, count(*) AS total_members
  FROM members JOIN supplier ON s_suppkey = set_id GROUP BY ALL)
LEFT JOIN (SELECT family, sum(jaccard) AS s, max(jaccard) AS hi, min(jaccard) AS lo, count(*) AS k FROM family_pairs GROUP BY family) USING (family) WHERE n_sets > 1""", "members family_pairs")
def family_overlap_summary(spark, sf):
    from foldwise.operators.joins import family_pairs

    fam, mem = families(spark, sf), i.members(spark, sf)
    return i.rounded(su.family_overlap_summary(family_pairs(mem, fam), mem, fam), "mean_jaccard", "max_jaccard", "min_jaccard", "redundancy")


def rank_sql(keys: str, groups: str, source: str = "results") -> str:
    part = f"PARTITION BY {keys[:-2]} " if keys else ""
    return f"""SELECT *, row_number() OVER ({part}ORDER BY n_sig DESC, n_total DESC, mean_abs_lff DESC, set_id) AS rank FROM (
SELECT {keys}set_id, CASE WHEN bool_or(tier = 'significant') THEN 'significant' WHEN bool_or(tier = 'display') THEN 'display' ELSE 'non_significant' END AS tier,
  count(*) FILTER (tier = 'significant') AS n_sig, count(*) AS n_total, count(DISTINCT grp) FILTER (tier = 'significant') || '/' || {groups} AS groups_sig,
  count(DISTINCT grp) || '/' || {groups} AS groups_total, array_to_string(list_sort(list_distinct(list(grp))), ', ') AS group_list,
  array_to_string(list_sort(list_distinct(list(timepoint))), ', ') AS timepoints, array_to_string(list_sort(list_distinct(list(condition))), ', ') AS conditions,
  round(avg(abs(lff)), 6) AS mean_abs_lff, round(min(p), 6) AS best_p, {', '.join(f"round(avg(lff) FILTER (condition = '{t}'), 6) AS lff_{t}" for t in i.TREATMENTS)}
FROM {source} GROUP BY {keys}set_id)"""


@query("F1", rank_sql("", "(SELECT count(DISTINCT grp) FROM results)"), "results")
def ranked_sets(spark, sf):
    return i.rounded(su.rank_sets(i.results(spark, sf), i.TREATMENTS), "mean_abs_lff", "best_p", *[f"lff_{t}" for t in i.TREATMENTS])


@query("F1", rank_sql("grp, ", "1"), "results")
def ranked_sets_by_group(spark, sf):
    return i.rounded(su.rank_sets(i.results(spark, sf), i.TREATMENTS, per_group=True), "mean_abs_lff", "best_p", *[f"lff_{t}" for t in i.TREATMENTS])


_LEVELS = rank_sql("level, grp, ", "groups", "levelled").replace("GROUP BY level, grp, set_id", "GROUP BY level, grp, set_id, groups").replace("count(DISTINCT grp)", "count(DISTINCT own)").replace("list(grp)", "list(own)")


@query("F1", _LEVELS, "levelled")
def ranked_sets_by_level(spark, sf):
    """The global ranking and that of each group in one table."""
    return i.rounded(su.rank_levels(i.results(spark, sf), i.TREATMENTS), "mean_abs_lff", "best_p", *[f"lff_{t}" for t in i.TREATMENTS])


@query("F2", f"SELECT {KEYS}, set_id, round(lff, 6) AS lff FROM results QUALIFY row_number() OVER (PARTITION BY {KEYS} ORDER BY round(abs(lff), 6) DESC, set_id) <= 20", "results")
def strongest_sets(spark, sf):
    return i.rounded(su.top_by_abs(i.results(spark, sf), i.COMPARISON, 20), "lff").select(*i.COMPARISON, "set_id", "lff")


@query("F17", """SELECT *, row_number() OVER (ORDER BY family, mean_abs_lff DESC, set_id) AS position FROM (
SELECT set_id, s_nationkey::VARCHAR AS family, round(avg(abs(lff)), 6) AS mean_abs_lff FROM results JOIN supplier ON s_suppkey = set_id GROUP BY ALL)""", "results")
def display_order(spark, sf):
    return i.rounded(su.display_order(i.results(spark, sf), families(spark, sf)), "mean_abs_lff")


@query("F13 B7", "SELECT * FROM (SELECT set_id, condition, grp, " + ", ".join(
    f"coalesce(bool_or(tier = 'significant') FILTER (timepoint = '{t}'), false) AS sig_{t}, coalesce(max(direction) FILTER (timepoint = '{t}'), '') AS direction_{t}, "
    f"round(max(lff) FILTER (timepoint = '{t}'), 6) AS lff_{t}" for t in i.TIMEPOINTS) + " FROM results GROUP BY ALL) WHERE sig_t1 OR sig_t2 OR sig_t3", "results")
def temporal_table(spark, sf):
    return i.rounded(su.temporal_table(i.results(spark, sf), i.TIMEPOINTS, p_col="p", p_sig=i.P_HIT), *[f"lff_{t}" for t in i.TIMEPOINTS])


fragment("evidence", f"SELECT {KEYS}, set_id, p, adj_p, -log10(greatest(p, 1e-300)) + 0 AS e FROM results", "results")


def with_evidence(spark, sf):
    return i.results(spark, sf).withColumn("e", su.evidence(F.col("p")))


fragment("levelled", """SELECT 'all' AS level, NULL AS grp, grp AS own, (SELECT count(DISTINCT grp) FROM results) AS groups, * EXCLUDE (grp) FROM results
UNION ALL SELECT 'group', grp, grp, 1, * EXCLUDE (grp) FROM results""", "results")
fragment("gini", f"""SELECT {KEYS}, (2 * sum(r * e) - (count(*) + 1) * sum(e)) / nullif(count(*) * sum(e), 0) AS gini
FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY e, set_id) AS r FROM evidence) GROUP BY {KEYS}""", "evidence")
for _k in (10, 20):
    fragment(f"top{_k}", f"""SELECT {KEYS}, sum(e) FILTER (r <= {_k}) / sum(e) AS top{_k}_share
FROM (SELECT *, row_number() OVER (PARTITION BY {KEYS} ORDER BY e DESC, set_id) AS r FROM evidence) GROUP BY {KEYS}""", "evidence")
fragment("hc", f"""SELECT {KEYS}, max(hc) AS hc, coalesce(min(r) FILTER (hc = top), 1) AS hc_index FROM (
  SELECT *, max(hc) OVER (PARTITION BY {KEYS}) AS top FROM (SELECT *, CASE WHEN p > 0 AND p < 1 THEN sqrt(n) * (r / n - p) / sqrt(p * (1 - p)) END AS hc
    FROM (SELECT {KEYS}, p, row_number() OVER (PARTITION BY {KEYS} ORDER BY p, set_id) AS r, count(*) OVER (PARTITION BY {KEYS}) AS n FROM results)
    WHERE r <= greatest(1, n // 2))) GROUP BY {KEYS}""", "results")


@query("F5", f"SELECT {KEYS}, round(gini, 6) AS gini FROM gini", "gini")
def gini(spark, sf):
    return i.rounded(su.gini(with_evidence(spark, sf), i.COMPARISON, "e"), "gini")


@query("F6", f"SELECT {KEYS}, round(top10_share, 6) AS top10_share FROM top10", "top10")
def top_share(spark, sf):
    return i.rounded(su.top_k_share(with_evidence(spark, sf), i.COMPARISON, "e", 10), "top10_share")


@query("F7", f"""SELECT {KEYS}, r AS point, round(CASE WHEN t = 0 THEN (r - 1) / (n - 1) ELSE r / n END, 6) AS x, round(CASE WHEN t = 0 THEN (r - 1) / (n - 1) ELSE c / t END, 6) AS y FROM (SELECT {KEYS}, row_number() OVER w AS r, count(*) OVER (PARTITION BY {KEYS}) AS n,
  sum(e) OVER (PARTITION BY {KEYS} ORDER BY e, set_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, sum(e) OVER (PARTITION BY {KEYS}) AS t
  FROM evidence WINDOW w AS (PARTITION BY {KEYS} ORDER BY e, set_id))
UNION ALL SELECT {KEYS}, 0, 0.0, 0.0 FROM evidence GROUP BY {KEYS} HAVING sum(e) <> 0""", "evidence")
def lorenz_curve(spark, sf):
    return i.rounded(su.lorenz(with_evidence(spark, sf), i.COMPARISON, "e"), "x", "y")


@query("H7", f"SELECT {KEYS}, round(hc, 6) AS hc, hc_index FROM hc", "hc")
def higher_criticism(spark, sf):
    return i.rounded(su.higher_criticism(i.results(spark, sf), i.COMPARISON, "p"), "hc")


@query("F8", f"""SELECT {KEYS}, n_p001, n_p01, n_p05, n_adj10, round(total_evidence, 6) AS total_evidence, round(max_evidence, 6) AS max_evidence, round(gini, 6) AS gini,
  round(top10_share, 6) AS top10_share, round(top20_share, 6) AS top20_share, round(hc, 6) AS hc, hc_index
FROM (SELECT {KEYS}, count(*) FILTER (p < 0.001) AS n_p001, count(*) FILTER (p < 0.01) AS n_p01, count(*) FILTER (p < 0.05) AS n_p05, count(*) FILTER (adj_p < 0.1) AS n_adj10,
  sum(e) AS total_evidence, max(e) AS max_evidence FROM evidence GROUP BY {KEYS})
JOIN gini USING ({KEYS}) JOIN top10 USING ({KEYS}) JOIN top20 USING ({KEYS}) JOIN hc USING ({KEYS})""", "evidence gini top10 top20 hc")
def signal_concentration(spark, sf):
    return i.rounded(su.signal_concentration(i.results(spark, sf), i.COMPARISON), "total_evidence", "max_evidence", "gini", "top10_share", "top20_share", "hc")


@query("F8", """SELECT grp, timepoint, round(a, 6) AS "T1", round(b, 6) AS "T2", round(c, 6) AS "T12", round(c - (a + b) / 2, 6) AS difference FROM (
SELECT grp, timepoint, max(gini) FILTER (condition = 'T1') AS a, max(gini) FILTER (condition = 'T2') AS b, max(gini) FILTER (condition = 'T12') AS c FROM gini GROUP BY ALL) WHERE a + b + c IS NOT NULL""", "gini")
def concentration_difference(spark, sf):
    table = su.gini(with_evidence(spark, sf), i.COMPARISON, "e")
    return i.rounded(su.single_versus_combined(table, i.CONTEXT, "gini", i.TREATMENTS), *i.TREATMENTS, "difference")


@query("F9", f"""SELECT {KEYS}, rank, round(-log10(rank / (n + 1)), 6) AS expected, round(-log10(greatest(p, 1e-300)) + 0, 6) AS observed
FROM (SELECT {KEYS}, p, row_number() OVER (PARTITION BY {KEYS} ORDER BY p, set_id) AS rank, count(*) OVER (PARTITION BY {KEYS}) AS n FROM results)""", "results")
def qq_points(spark, sf):
    return i.rounded(su.qq_points(i.results(spark, sf), i.COMPARISON, "p"), "expected", "observed")
