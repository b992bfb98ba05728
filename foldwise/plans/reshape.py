"""Reshaping, parsing and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import columns as c
from foldwise.operators import enrichment as en
from foldwise.operators import reshape as rs
from foldwise.plans import inputs as i
from foldwise.plans.registry import fragment, query

SAMPLES = [f"{g}_{t}_{k}" for g in ("F", "O") for t in i.TIMEPOINTS for k in i.CONDITIONS]
BRANDS = {f"Brand#{n}": ("low" if n <= 5 else "mid" if n <= 12 else "high") for n in range(0, 18)}
SEGMENT_POOL = {"AUTOMOBILE": "goods", "MACHINERY": "goods", "FURNITURE": "home", "HOUSEHOLD": "home"}

fragment("samples", """SELECT g || '_' || t || '_' || c AS sample_id, g AS gender, t AS timepoint, c AS condition
FROM (VALUES ('F'), ('O')) a(g), (VALUES ('t1'), ('t2'), ('t3')) b(t), (VALUES ('C'), ('T1'), ('T2'), ('T12')) d(c)""")


def wide_bulk(spark, sf):
    return rs.widen(i.bulk(spark, sf), ["feature_id"], "sample_id", SAMPLES, F.sum("value"))


@query("B6", "SELECT feature_id, " + ", ".join(f"sum(value) FILTER (sample_id = '{s}') AS \"{s}\"" for s in SAMPLES)
       + " FROM bulk GROUP BY feature_id", "bulk")
def wide_matrix(spark, sf):
    return wide_bulk(spark, sf)


@query("B2", """SELECT f.feature_id, s.gender, s.timepoint, s.condition, b.value
FROM (SELECT DISTINCT feature_id FROM bulk) f CROSS JOIN samples s LEFT JOIN bulk b USING (feature_id, sample_id)""", "bulk samples")
def unpivot_matrix(spark, sf):
    return rs.unpivot_matrix(wide_bulk(spark, sf), ["feature_id"], "([FO])_(t[123])_(.+)", ["gender", "timepoint", "condition"])


@query("B3", """SELECT CASE gender WHEN 'F' THEN 'fe' WHEN 'O' THEN 'ma' END AS gender,
  CASE condition WHEN 'C' THEN 'control' WHEN 'T12' THEN 'combined' ELSE condition END AS condition, count(*) AS n FROM base GROUP BY ALL""", "base")
def canonical_codes(spark, sf):
    df = rs.canonicalise(i.base(spark, sf), "gender", {"F": "fe", "O": "ma"})
    return rs.canonicalise(df, "condition", {"C": "control", "T12": "combined"}).groupBy("gender", "condition").agg(F.count(F.lit(1)).alias("n"))


@query("B4", """SELECT split_part(sample_id, '_', 1) AS gender, split_part(sample_id, '_', 2) AS timepoint, split_part(sample_id, '_', 3) AS condition,
  count(*) AS n, sum(value) AS total FROM bulk GROUP BY ALL""", "bulk")
def parse_sample_ids(spark, sf):
    return (i.bulk(spark, sf).select(rs.parse_sample_id(F.col("sample_id")).alias("s"), "value").select("s.*", "value")
            .groupBy("gender", "timepoint", "condition").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("B5", """SELECT grp || '_' || timepoint || '_C_vs_' || grp || '_' || timepoint || '_' || condition || '_pct5' AS comparison,
  grp, timepoint, condition, 5.0::DOUBLE AS pct, count(*) AS n FROM enriched GROUP BY ALL""", "enriched")
def comparison_names(spark, sf):
    named = i.results(spark, sf).select(rs.comparison_name(F.col("grp"), F.col("timepoint"), F.col("condition"), "C", 5.0).alias("comparison"))
    parsed = named.select("comparison", rs.parse_comparison(F.col("comparison"), i.GROUPS, i.TIMEPOINTS, i.TREATMENTS).alias("k")).select("comparison", "k.*")
    return parsed.groupBy("comparison", "grp", "timepoint", "condition", "pct").agg(F.count(F.lit(1)).alias("n"))


@query("B5", """SELECT CASE gender WHEN 'F' THEN 'Female' ELSE gender END || ' ' || condition || ' ' || timepoint AS label, count(*) AS n FROM bulk GROUP BY ALL""", "bulk")
def short_labels(spark, sf):
    label = rs.short_label(F.col("gender"), F.col("condition"), F.col("timepoint"), {"F": "Female"})
    return i.bulk(spark, sf).groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("B7", """SELECT s.set_id, c.condition, t.timepoint, coalesce(n, 0) AS n FROM (SELECT DISTINCT set_id FROM hits) s
CROSS JOIN (VALUES ('T1'), ('T2'), ('T12')) c(condition) CROSS JOIN (VALUES ('t1'), ('t2'), ('t3')) t(timepoint)
LEFT JOIN (SELECT set_id, condition, timepoint, count(*) AS n FROM hits GROUP BY ALL) h USING (set_id, condition, timepoint)""", "hits")
def densified_hits(spark, sf):
    hits = i.results(spark, sf).where("tier = 'significant'").groupBy("set_id", "condition", "timepoint").agg(F.count(F.lit(1)).alias("n"))
    return rs.densify(hits, ["set_id"], {"condition": i.TREATMENTS, "timepoint": i.TIMEPOINTS}, {"n": 0})


fragment("hits", "SELECT * FROM results WHERE tier = 'significant'", "results")


@query("B8", "SELECT set_id, grp, timepoint, 'lff_' || condition AS column, round(lff, 6) AS value FROM results WHERE tier <> 'non_significant'", "results")
def melted_cells(spark, sf):
    wide = i.results(spark, sf).groupBy("set_id", "grp", "timepoint").pivot("condition", i.TREATMENTS).agg(
        F.first("lff").alias("lff"), F.first(F.col("tier") != "non_significant").alias("keep"))
    for t in i.TREATMENTS:
        wide = wide.withColumnRenamed(f"{t}_lff", f"lff_{t}").withColumn(f"{t}_keep", F.coalesce(f"{t}_keep", F.lit(False)))
    cells = rs.melt_cells(wide, ["set_id", "grp", "timepoint"], [f"lff_{t}" for t in i.TREATMENTS], [f"{t}_keep" for t in i.TREATMENTS])
    return i.rounded(cells, "value")


@query("B9", """SELECT feature_id, sum(value) FILTER (condition IN ('T1', 'T12')) AS first_total, sum(value) FILTER (condition IN ('T2', 'T12')) AS second_total,
  sum(value) FILTER (condition = 'T12') AS both_total FROM bulk GROUP BY feature_id""", "bulk")
def factorial_totals(spark, sf):
    df = rs.factorial_columns(i.bulk(spark, sf))
    total = lambda x: F.sum(F.when(F.col(x) == 1, F.col("value"))).alias(f"{x}_total")
    return df.groupBy("feature_id").agg(total("first"), total("second"), total("both"))


@query("B10", """SELECT feature_id, timepoint, condition, CASE WHEN grp IN ('AUTOMOBILE', 'MACHINERY') THEN 'goods'
  WHEN grp IN ('FURNITURE', 'HOUSEHOLD') THEN 'home' ELSE 'Other' END AS grp, sum(value) AS value FROM cells GROUP BY ALL""", "cells")
def pooled_groups(spark, sf):
    return rs.pool_labels(i.cells(spark, sf), ["feature_id", "timepoint", "condition"], "grp", SEGMENT_POOL, "value", "Other")


@query("B11", """SELECT coalesce(k2.pooled, k1.pooled, k0.pooled, 'Other') AS pooled,
  CASE WHEN k0.prefix IS NOT NULL THEN 0 WHEN k1.prefix IS NOT NULL THEN right(label, 1)::BIGINT WHEN k2.prefix IS NOT NULL THEN right(label, 2)::BIGINT
    ELSE regexp_extract(label, '([0-9]+)$', 1)::BIGINT END AS number,
  (k0.prefix IS NOT NULL OR k1.prefix IS NOT NULL OR k2.prefix IS NOT NULL) AS known, count(*) AS n
FROM (SELECT p_brand || CAST(l_linenumber AS VARCHAR) AS label FROM lineitem JOIN part ON l_partkey = p_partkey)
LEFT JOIN known_prefixes k0 ON k0.prefix = label
LEFT JOIN known_prefixes k1 ON k0.prefix IS NULL AND k1.prefix = left(label, length(label) - 1)
LEFT JOIN known_prefixes k2 ON k0.prefix IS NULL AND k1.prefix IS NULL AND k2.prefix = left(label, length(label) - 2)
GROUP BY ALL""", "known_prefixes")
def prefix_labels(spark, sf):
    lines = i.table(spark, sf, "lineitem").select("l_partkey", "l_linenumber").join(
        i.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    label = F.concat(F.col("p_brand"), F.col("l_linenumber").cast("string"))
    return (lines.select(rs.match_prefix(label, BRANDS).alias("m")).groupBy("m.pooled", "m.number", "m.known").agg(F.count(F.lit(1)).alias("n")))


fragment("known_prefixes", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in BRANDS.items()) + ") v(prefix, pooled)")


@query("B12", """SELECT l_returnflag, count(v) AS n, sum(v) AS total, count(*) - count(v) AS missing FROM (SELECT l_returnflag, TRY_CAST(
  CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE l_quantity END AS DOUBLE) AS v FROM lineitem) GROUP BY ALL""")
def optional_numbers(spark, sf):
    text = (F.when(F.col("l_linenumber") == 1, "NA").when(F.col("l_linenumber") == 2, " ").when(F.col("l_linenumber") == 3, "NaN")
            .otherwise(F.col("l_quantity").cast("string")))
    value = c.clean(c.optional_double(text))
    return (i.table(spark, sf, "lineitem").select("l_returnflag", value.alias("v")).groupBy("l_returnflag")
            .agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.count_if(F.col("v").isNull()).alias("missing")))


@query("B13", """SELECT upper(p_type[1]) || lower(p_type[2:]) AS mouse, upper(p_name) AS human, count(*) AS n FROM part GROUP BY ALL""")
def symbol_case(spark, sf):
    return (i.table(spark, sf, "part").groupBy(c.gene_case(F.col("p_type")).alias("mouse"), c.gene_case(F.col("p_name"), "Human").alias("human"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("B14", """SELECT DISTINCT user_id, item FROM (SELECT user_id, unnest([event_type, 'k' || regexp_extract(props, '([0-9]+)', 1)]) AS item FROM events)""")
def list_items(spark, sf):
    text = F.concat(F.lit("['"), "event_type", F.lit("', 'k"), F.regexp_extract("props", "([0-9]+)", 1), F.lit("', '"), "event_type", F.lit("']"))
    return rs.explode_list(i.table(spark, sf, "events").select("user_id", text.alias("items")), ["user_id"], "items", "item")


@query("B15", "SELECT regexp_extract(c_name, '#0*([0-9]+)$', 1) || '_' || c_mktsegment AS id, c_acctbal FROM customer")
def composite_ids(spark, sf):
    return i.table(spark, sf, "customer").select(rs.composite_id(F.col("c_name"), "#0*([0-9]+)$", F.col("c_mktsegment")).alias("id"), "c_acctbal")


@query("B16", """SELECT CASE WHEN contains(p_name, 'small') THEN 'S' ELSE 'WT' END AS flag, p_type, count(*) AS n FROM part GROUP BY ALL""")
def label_flags(spark, sf):
    return (i.table(spark, sf, "part").groupBy(rs.label_flag(F.col("p_name"), "small", "S", "WT").alias("flag"), "p_type").agg(F.count(F.lit(1)).alias("n")))


@query("B17", "SELECT grp, timepoint, condition, set_id, evidence FROM results", "results")
def evidence_tiers(spark, sf):
    return i.results(spark, sf).select("grp", "timepoint", "condition", "set_id", c.evidence_tier(F.col("median_lfc")).alias("evidence"))


@query("B18", f"""SELECT set_id, grp, timepoint, condition, (CASE WHEN lff >= 1.2 THEN 4 WHEN lff >= 0.4 THEN 3 WHEN lff >= -0.4 THEN 2 WHEN lff >= -1.2 THEN 1 ELSE 0 END - 2.0::DOUBLE) / 2 AS score,
  CASE WHEN p <= {i.P_HIT} THEN sign(lff)::DOUBLE ELSE 0.0 END AS sig_direction FROM results""", "results")
def tier_scores(spark, sf):
    return i.results(spark, sf).select(
        "set_id", "grp", "timepoint", "condition", c.tier_score(F.col("lff")).alias("score"),
        (F.when(F.col("p") <= i.P_HIT, F.signum("lff")).otherwise(F.lit(0.0)) + F.lit(0.0)).alias("sig_direction"))


def fractions(spark, sf):
    totals = i.deconvoluted(spark, sf).groupBy("sample_id", "grp").agg(F.sum("value").alias("fraction"))
    return rs.renormalise(totals, ["sample_id"], "fraction")


fragment("fractions", "SELECT sample_id, grp, sum(value) / sum(sum(value)) OVER (PARTITION BY sample_id) AS fraction FROM decon GROUP BY sample_id, grp", "decon")


@query("B19", "SELECT sample_id, grp, round(fraction, 6) AS fraction FROM fractions", "fractions")
def renormalised_fractions(spark, sf):
    return i.rounded(fractions(spark, sf), "fraction")


@query("B20", """SELECT feature_id, timepoint, round(coalesce(CASE WHEN a = 0 OR b = 0 THEN NULL ELSE greatest(a / b, b / a) END, 0), 6) AS magnitude
FROM (SELECT feature_id, timepoint, sum(value) FILTER (condition = 'T12') AS a, sum(value) FILTER (condition = 'C') AS b FROM bulk GROUP BY ALL)""", "bulk")
def fold_magnitudes(spark, sf):
    wide = rs.widen(i.bulk(spark, sf), ["feature_id", "timepoint"], "condition", i.CONDITIONS, F.sum("value"))
    return wide.select("feature_id", "timepoint", i.r6(c.fold_magnitude(F.col("T12"), F.col("C"))).alias("magnitude"))


def profiles(spark, sf):
    return i.deconvoluted(spark, sf).groupBy("feature_id", "grp").agg(F.avg("value").alias("value"))


fragment("profiles", "SELECT feature_id, grp, avg(value) AS value FROM decon GROUP BY ALL", "decon")


@query("B21", """SELECT p.feature_id, f.sample_id, p.grp, round(CASE WHEN b.value IS NULL THEN NULL ELSE p.value * f.fraction END, 6) AS value
FROM profiles p JOIN fractions f USING (grp) LEFT JOIN bulk b ON b.feature_id = p.feature_id AND b.sample_id = f.sample_id""", "profiles fractions bulk")
def group_contributions(spark, sf):
    return i.rounded(rs.contributions(profiles(spark, sf), fractions(spark, sf), i.bulk(spark, sf)), "value").select("feature_id", "sample_id", "grp", "value")
