"""Sampling, permutation and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import corrections as co
from foldwise.operators import enrichment as en
from foldwise.operators import sampling as sa
from foldwise.operators import summaries as su
from foldwise.plans import inputs as i
from foldwise.plans.joins import families
from foldwise.plans.normalise import strata
from foldwise.plans.registry import fragment, query
from foldwise.plans.summaries import effective, rank_sql
from foldwise.session import staged

KEYS = "grp, timepoint, condition"
N_PERM = 1000
STOP = 20


@query("F11", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def ordered_distinct(spark, sf):
    return sa.ordered_distinct(i.table(spark, sf, "events"), "user_id", "event_id")


@query("F12", "SELECT feature_id, condition, value FROM plain QUALIFY rank() OVER (PARTITION BY condition ORDER BY value DESC) <= 500", "plain")
def top_with_ties(spark, sf):
    return sa.top_n_ties(i.plain(spark, sf), ["condition"], "value", 500).select("feature_id", "condition", "value")


def sample_totals(spark, sf):
    """Marker sums per sample."""
    part = i.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), "p_type")
    rows = i.bulk(spark, sf).join(part, "feature_id")
    total = lambda t: F.sum(F.when(F.col("p_type") == t, F.col("value")).otherwise(0.0))
    return rows.groupBy("sample_id", "gender", "condition").agg(
        total("ECONOMY").alias("first"), total("PROMO").alias("second"), total("STANDARD").alias("female"), total("SMALL").alias("male"))


fragment("sample_totals", """SELECT sample_id, gender, condition, sum(CASE WHEN p_type = 'ECONOMY' THEN value ELSE 0 END) AS first, sum(CASE WHEN p_type = 'PROMO' THEN value ELSE 0 END) AS second,
  sum(CASE WHEN p_type = 'STANDARD' THEN value ELSE 0 END) AS female, sum(CASE WHEN p_type = 'SMALL' THEN value ELSE 0 END) AS male
FROM bulk JOIN part ON p_partkey = feature_id GROUP BY ALL""", "bulk")


@query("F14", "SELECT sample_id, first, row_number() OVER (ORDER BY first DESC, sample_id) <= 12 AS has_first FROM sample_totals", "sample_totals")
def top_marker(spark, sf):
    return sa.top_marker(sample_totals(spark, sf), "first", "has_first").select("sample_id", "first", "has_first")


@query("F15", """SELECT feature_id, stratum FROM strata JOIN (SELECT stratum, greatest(floor(count(*) * 0.2), 25) AS take FROM strata GROUP BY stratum) USING (stratum)
QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5(feature_id || ':7'), feature_id) <= any_value(take) OVER (PARTITION BY stratum)""", "strata")
def stratified_sample(spark, sf):
    return sa.stratified_sample(strata(spark, sf), "stratum", 0.2, 25, 7).select("feature_id", "stratum")


@query("F16", """SELECT a.sample_id, a.gender, a.timepoint, b.condition FROM own a JOIN own b ON a.gender = b.gender AND a.timepoint = b.timepoint AND a.r = b.s""", "own")
def restricted_permutation(spark, sf):
    samples = i.bulk(spark, sf).select("sample_id", "gender", "timepoint", "condition").distinct()
    return sa.restricted_permutation(samples, ["gender", "timepoint"], "condition", 11).select("sample_id", "gender", "timepoint", "condition")


fragment("own", """SELECT *, row_number() OVER (PARTITION BY gender, timepoint ORDER BY sample_id) AS r,
  row_number() OVER (PARTITION BY gender, timepoint ORDER BY md5(sample_id || ':11'), sample_id) AS s FROM seen""", "seen")
fragment("seen", "SELECT DISTINCT sample_id, gender, timepoint, condition FROM bulk", "bulk")


@query("F18", "SELECT p_partkey, p_name, ntile(7) OVER (ORDER BY p_name, p_partkey)::INTEGER AS page FROM part")
def paginated_parts(spark, sf):
    return sa.paginate(i.table(spark, sf, "part").select("p_partkey", "p_name"), 7, [F.col("p_name"), F.col("p_partkey")])


_HITS = "(a_up + a_down + e.c)"


def _null_tail(a: str) -> str:
    return i._tail_sql(a, "n_up")


_AT = co.scattered_sql("x", "side", lambda j: f"k{j}", "//")
_KEYS8 = ", ".join(f"('0x' || substr(h, {4 * j + 1}, 4))::BIGINT AS k{j}" for j in range(8))
fragment("draws", f"""SELECT {KEYS}, perm, k, unnest(range(len(ys))) AS spot, unnest(ys) AS number FROM (
  SELECT *, list_filter(list_transform(range(0, 2 * k + side * side - n), lambda x: {_AT}), lambda y: y < n)[1:2 * k] AS ys FROM (
    SELECT *, {_KEYS8} FROM (SELECT *, ceil(sqrt(n))::BIGINT AS side, md5(perm || ':42:' || grp || ':' || timepoint || ':' || condition) AS h
      FROM (SELECT {KEYS}, any_value(n) AS n, any_value(k) AS k FROM classes GROUP BY {KEYS}) CROSS JOIN range(1, {N_PERM + 1}) p(perm) WHERE k > 0)))""", "classes")
fragment("numbered", f"SELECT {KEYS}, feature_id, row_number() OVER (PARTITION BY {KEYS} ORDER BY feature_id) - 1 AS number FROM classes", "classes")
fragment("drawn_hits", f"""SELECT {KEYS}, set_id, up, down, count(*) AS times FROM (
  SELECT {KEYS}, set_id, perm, count(*) FILTER (spot >= k) AS up, count(*) FILTER (spot < k) AS down
  FROM draws JOIN numbered USING ({KEYS}, number) JOIN members USING (feature_id) GROUP BY {KEYS}, set_id, perm) GROUP BY ALL""", "draws numbered members")
fragment("drawn_tables", f"""SELECT {KEYS}, set_id, h.up, h.down, times, e.n_up, e.n_bg, e.p, {_HITS} - h.up - h.down AS c
FROM drawn_hits h JOIN enriched e USING ({KEYS}, set_id)""", "drawn_hits enriched")
fragment("null_p", f"""SELECT {KEYS}, set_id, p, times, q FROM drawn_tables JOIN (
  SELECT up, down, n_up, n_bg, c, least({_null_tail('up')}, {_null_tail('down')}) AS q FROM (SELECT DISTINCT up, down, n_up, n_bg, c FROM drawn_tables)) USING (up, down, n_up, n_bg, c)""", "drawn_tables")
fragment("perm_p", f"""SELECT e.{KEYS.replace(', ', ', e.')}, e.set_id, e.p, e.adj_p, (CASE WHEN e.p * (1 + 1e-9) >= 1 THEN {N_PERM} ELSE coalesce(b.n, 0) END + 1) / {N_PERM + 1}.0 AS perm_p
FROM enriched e LEFT JOIN (SELECT {KEYS}, set_id, sum(times) FILTER (q <= p * (1 + 1e-9)) AS n FROM null_p GROUP BY {KEYS}, set_id) b USING ({KEYS}, set_id)""", "null_p enriched")


def _choose(n: str, k: str) -> str:
    return f"lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0)"


# The sequential test draws each set from its own law: every outcome of a draw of both sides, its chance and its p.
fragment("outcomes", f"""SELECT *, exp({_choose('n_up', 'up')} + {_choose('n_up', 'down')} + {_choose('n_bg', 'c')} - ({_choose('(2 * n_up + n_bg)', 'hits')})) AS chance,
  least({_null_tail('up')}, {_null_tail('down')}) AS q
FROM (SELECT *, hits - up - down AS c FROM (SELECT *, unnest(range(0, least(hits, n_up) + 1)) AS down FROM (SELECT *, unnest(range(0, least(hits, n_up) + 1)) AS up
  FROM (SELECT DISTINCT n_up, n_bg, a_up + a_down + c AS hits FROM enriched WHERE n_up > 0)))) WHERE c BETWEEN 0 AND n_bg""", "enriched")
fragment("shares", f"""SELECT {KEYS}, set_id, any_value(p) AS p, least(1.0, coalesce(sum(chance) FILTER (q <= p * (1 + 1e-9)), 0)) AS share
FROM enriched e LEFT JOIN outcomes o ON o.n_up = e.n_up AND o.n_bg = e.n_bg AND o.hits = e.a_up + e.a_down + e.c GROUP BY {KEYS}, set_id""", "enriched outcomes")
fragment("levels", f"""SELECT {KEYS}, set_id, CASE WHEN p * (1 + 1e-9) >= 1 OR share >= 1 THEN 'g' ELSE printf('%08x', floor(share * 4294967296)::BIGINT) END AS level,
  concat_ws(':', '42', grp, timepoint, condition, set_id, '') AS key FROM shares""", "shares")
_DRAWS = "flatten(list_transform(range(0, {n}), lambda b: list_transform(range(0, 4), lambda j: substr(md5(key || b), 8 * j + 1, 8))))"
fragment("beaten", f"""SELECT {KEYS}, set_id, list_filter(list_transform({_DRAWS.format(n=N_PERM // 4)}, lambda u, i: CASE WHEN u < level THEN i ELSE 0 END), lambda i: i > 0) AS beats FROM levels""", "levels")


def permuted(spark, sf):
    """The enrichment table with its permutation p."""
    return staged(spark, ("permuted", sf), lambda: co.shuffled_pvalues(
        i.classes(spark, sf), i.members(spark, sf), i.results(spark, sf), i.COMPARISON, N_PERM))


def corrected_by_permutation(spark, sf):
    """Results whose adjusted p, tiers and tails rest on the permutations."""
    rows = co.correct(permuted(spark, sf).drop("tier", "lff_low", "lff_high"), i.COMPARISON, "permutation")
    return en.significance_tier(rows, i.COMPARISON, p_col="adj_p")


fragment("by_permutation", f"""SELECT r.* EXCLUDE (adj_p, tier), r.adj_p AS bh_p, perm_p::DOUBLE AS adj_p, CASE WHEN abs(lff) >= 0.01 AND perm_p <= 0.1 THEN 'significant'
  WHEN (lff >= lff_high - 1e-9 OR lff <= lff_low + 1e-9) AND perm_p < 0.5 THEN 'display' ELSE 'non_significant' END AS tier
FROM results r JOIN (SELECT {KEYS}, set_id, perm_p FROM perm_p) USING ({KEYS}, set_id)""", "results perm_p")


@query("H4", f"SELECT {KEYS}, set_id, round(perm_p, 6)::DOUBLE AS perm_p FROM perm_p", "perm_p")
def permutation_pvalues(spark, sf):
    return i.rounded(permuted(spark, sf), "perm_p").select(*i.COMPARISON, "set_id", "perm_p")


@query("H4", f"""SELECT {KEYS}, set_id, CASE WHEN len(beats) >= {STOP} THEN beats[{STOP}] ELSE {N_PERM} END::INTEGER AS n_drawn,
  round(CASE WHEN len(beats) >= {STOP} THEN {STOP}.0 / beats[{STOP}] ELSE (len(beats) + 1) / {N_PERM + 1}.0 END, 6)::DOUBLE AS perm_p FROM beaten""", "beaten")
def sequential_permutation_pvalues(spark, sf):
    """The test by the law of each set, which stops drawing once the set has been beaten often enough."""
    rows = co.permutation_pvalues(i.results(spark, sf), i.COMPARISON, N_PERM, stop=STOP)
    return i.rounded(rows, "perm_p").select(*i.COMPARISON, "set_id", "n_drawn", "perm_p")


@query("H5", f"SELECT {KEYS}, set_id, round(adj_p, 6) AS bh_p, round(alt_p, 6) AS adj_p, 'meff_bh' AS method FROM corrected", "corrected")
def chosen_correction(spark, sf):
    df = co.correct(i.results(spark, sf), i.COMPARISON, "meff_bh", effective=effective(spark, sf))
    return i.rounded(df, "bh_p", "adj_p").select(*i.COMPARISON, "set_id", "bh_p", "adj_p", F.lit("meff_bh").alias("method"))


@query("H5", f"SELECT {KEYS}, set_id, round(adj_p, 6) AS bh_p, round(adj_p, 6) AS adj_p, 'bh' AS method FROM enriched", "enriched")
def plain_correction(spark, sf):
    df = co.correct(i.results(spark, sf), i.COMPARISON, "bh")
    return i.rounded(df, "bh_p", "adj_p").select(*i.COMPARISON, "set_id", "bh_p", "adj_p", F.lit("bh").alias("method"))


@query("H5 C6", f"SELECT {KEYS}, set_id, round(bh_p, 6) AS bh_p, round(adj_p, 6) AS adj_p, tier, 'permutation' AS method FROM by_permutation", "by_permutation")
def permutation_correction(spark, sf):
    df = i.rounded(corrected_by_permutation(spark, sf), "bh_p", "adj_p")
    return df.select(*i.COMPARISON, "set_id", "bh_p", "adj_p", "tier", F.lit("permutation").alias("method"))


@query("E1 H5", f"""SELECT {KEYS}, count(*) FILTER (abs(lff) >= 0.01 AND adj_p <= 0.1) AS n_sig, count(*) AS n_tested,
  round(avg(abs(lff)), 6) AS mean_abs_lff FROM by_permutation GROUP BY ALL""", "by_permutation")
def permutation_summary(spark, sf):
    return i.rounded(su.comparison_summary(corrected_by_permutation(spark, sf), i.COMPARISON), "mean_abs_lff")


@query("E4 H5", f"""SELECT {KEYS}, count(*) FILTER (abs(lff) >= 0.01 AND bh_p <= 0.201) AS n_first, count(*) FILTER (abs(lff) >= 0.01 AND adj_p <= 0.201) AS n_second,
  count(*) FILTER (change = 'gained') AS n_gained, count(*) FILTER (change = 'lost') AS n_lost, count(*) FILTER (change = 'gained') - count(*) FILTER (change = 'lost') AS net_change,
  coalesce(array_to_string((list(set_id ORDER BY set_id) FILTER (change = 'gained'))[1:10], ', '), '') AS gained,
  coalesce(array_to_string((list(set_id ORDER BY set_id) FILTER (change = 'lost'))[1:10], ', '), '') AS lost
FROM (SELECT *, CASE WHEN abs(lff) >= 0.01 AND adj_p <= 0.201 AND NOT bh_p <= 0.201 THEN 'gained' WHEN abs(lff) >= 0.01 AND bh_p <= 0.201 AND NOT adj_p <= 0.201 THEN 'lost' END AS change
  FROM by_permutation) GROUP BY {KEYS}""", "by_permutation")
def permutation_recovery(spark, sf):
    return su.correction_recovery(corrected_by_permutation(spark, sf), i.COMPARISON, "bh_p", "adj_p", 0.201)


@query("F1 H5", rank_sql("", "(SELECT count(DISTINCT grp) FROM by_permutation)", "by_permutation"), "by_permutation")
def permutation_ranks(spark, sf):
    return i.rounded(su.rank_sets(corrected_by_permutation(spark, sf), i.TREATMENTS), "mean_abs_lff", "best_p", *[f"lff_{t}" for t in i.TREATMENTS])


@query("H6")
def effective_tests(spark, sf):
    """Sets pooled by nation, so that the set-by-set matrix keeps its size at any scale."""
    pooled = i.members(spark, sf).join(families(spark, sf), "set_id").select("feature_id", F.col("family").alias("set_id")).distinct()
    return spark.createDataFrame([(co.m_eff(pooled),)], "m_eff int")
