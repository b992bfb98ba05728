"""Joins, lookups, overlaps and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import grids
from foldwise.operators import joins as jo
from foldwise.plans import inputs as i
from foldwise.plans.registry import fragment, query

GRID = [(pct, p, lff) for pct in i.SWEEP_PCTS for p in (0.201, 0.401) for lff in (0.01, 0.101, 0.501)]


@query("D1", "SELECT DISTINCT feature_id FROM bulk SEMI JOIN (SELECT feature_id FROM decon WHERE value >= 100) d USING (feature_id)", "bulk decon")
def aligned_features(spark, sf):
    return jo.align_features(i.bulk(spark, sf), i.deconvoluted(spark, sf).where("value >= 100"), "feature_id")


@query("D2", """SELECT coalesce(a.id, b.id) AS user_id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'common' END AS side
FROM (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase') a FULL JOIN (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 0) b ON a.id = b.id""")
def sample_overlap(spark, sf):
    a = i.table(spark, sf, "events").where("event_type = 'purchase'").select("user_id")
    b = i.table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return jo.sample_overlap(a, b, "user_id")


def edges(spark, sf):
    """(brand, size) -> supplier edges, from the largest order lines."""
    part = i.table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    return (i.table(spark, sf, "lineitem").where("l_quantity = 50").select("l_partkey", F.col("l_suppkey").alias("set_id"))
            .join(part, "l_partkey").select("p_brand", "p_size", "set_id").distinct())


def upstream(spark, sf):
    allowed = i.table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("set_id"))
    features = i.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), "p_brand", "p_size")
    return features, jo.upstream_sets(features, edges(spark, sf), allowed, ["p_brand", "p_size"])


fragment("edges", "SELECT DISTINCT p_brand, p_size, l_suppkey AS set_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity = 50")
fragment("upstream", """SELECT DISTINCT p_partkey AS feature_id, set_id FROM part JOIN edges USING (p_brand, p_size)
WHERE set_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""", "edges")


@query("D3", "SELECT * FROM upstream", "upstream")
def upstream_sets(spark, sf):
    return upstream(spark, sf)[1]


@query("D3", """SELECT count(DISTINCT feature_id) AS n_matched, (SELECT count(*) FROM part) AS n_features,
  round(count(DISTINCT feature_id) / (SELECT count(*) FROM part), 6) AS rate FROM upstream""", "upstream")
def upstream_match_rate(spark, sf):
    return i.rounded(jo.match_rate(*upstream(spark, sf)), "rate")


_TRIPLET = ", ".join(f"round(lff_{t}, 6) AS lff_{t}, round(p_{t}, 6) AS p_{t}, dir_{t}, n_{t}::DOUBLE AS n_{t}, round(median_{t}, 6) AS median_{t}, sig_{t}" for t in i.TREATMENTS)


@query("D4", f"SELECT grp, timepoint, set_id, {_TRIPLET}, round(lff_sum, 6) AS lff_sum, round(lff_residual, 6) AS lff_residual FROM triplets", "triplets")
def condition_triplets(spark, sf):
    df = jo.condition_triplets(i.results(spark, sf), i.CONTEXT, i.TREATMENTS, p_col="p", p_sig=i.P_HIT)
    df = df.withColumns({f"n_{t}": F.col(f"n_{t}").cast("double") for t in i.TREATMENTS})
    return i.rounded(df, "lff_sum", "lff_residual", *[f"{k}_{t}" for t in i.TREATMENTS for k in ("lff", "p", "median")])


_LABELS = [f"{g}_{t}_{c}" for g in i.GROUPS for t in i.TIMEPOINTS for c in i.TREATMENTS]


@query("D5", "SELECT set_id, " + ", ".join(f"max(round(lff, 6)) FILTER (grp || '_' || timepoint || '_' || condition = '{x}') AS \"{x}\"" for x in _LABELS)
       + " FROM enriched GROUP BY set_id", "enriched")
def assembled_columns(spark, sf):
    df = i.rounded(i.results(spark, sf), "lff")
    return jo.assemble_columns(df, "set_id", F.concat_ws("_", "grp", "timepoint", "condition"), _LABELS, "lff")


_BAG = "l_orderkey, l_linenumber, l_suppkey, l_extendedprice"


@query("D6", f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {_BAG}) AS occurrence FROM lineitem WHERE l_linestatus = 'F'),
r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY {_BAG}) AS occurrence FROM lineitem WHERE l_linestatus = 'O')
SELECT CASE WHEN r.l_partkey IS NULL THEN 'missing' WHEN l.l_partkey IS NULL THEN 'unused' ELSE 'pair' END AS kind,
  coalesce(l.l_partkey, r.l_partkey) AS l_partkey, coalesce(l.l_returnflag, r.l_returnflag) AS l_returnflag,
  coalesce(l.occurrence, r.occurrence) AS occurrence, coalesce(l.l_orderkey, -1) AS left_order, coalesce(r.l_orderkey, -1) AS right_order
FROM l FULL JOIN r USING (l_partkey, l_returnflag, occurrence)""")
def bag_join(spark, sf):
    lines = i.table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_linestatus")
    left, right = (lines.where(F.col("l_linestatus") == s).drop("l_linestatus") for s in ("F", "O"))
    rows = jo.bag_pairs(left, right, ["l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"])
    kind = F.when(F.col("right").isNull(), "missing").when(F.col("left").isNull(), "unused").otherwise("pair")
    order = lambda side: F.coalesce(F.col(f"{side}.l_orderkey"), F.lit(-1).cast("long")).alias(f"{side}_order")
    return rows.select(kind.alias("kind"), "l_partkey", "l_returnflag", "occurrence", order("left"), order("right"))


@query("D7", """SELECT grp, timepoint, condition, set_id, coalesce(n_name, 'Other') AS family, coalesce(n_experiments, 0)::BIGINT AS n_experiments
FROM enriched LEFT JOIN (SELECT s_suppkey AS set_id, n_name, 1::BIGINT AS n_experiments FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0) USING (set_id)""", "enriched")
def annotated_results(spark, sf):
    nation = i.table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("family"))
    dim = (i.table(spark, sf, "supplier").where("s_acctbal > 0").join(nation, "s_nationkey")
           .select(F.col("s_suppkey").alias("set_id"), "family", F.lit(1).cast("long").alias("n_experiments")))
    return jo.annotate(i.results(spark, sf).select(*i.COMPARISON, "set_id"), dim, "set_id", {"family": "Other", "n_experiments": 0})


@query("D7", """SELECT l_linenumber, CASE l_linenumber WHEN 1 THEN 'F_t1_C' WHEN 2 THEN 'F_t1_T1' ELSE 'unmapped_' || l_linenumber END AS sample_id, count(*) AS n FROM lineitem GROUP BY ALL""")
def remapped_samples(spark, sf):
    mapping = spark.createDataFrame([(1, "F_t1_C"), (2, "F_t1_T1")], "l_linenumber int, sample_id string")
    counts = i.table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return jo.unmapped_default(counts, "l_linenumber", mapping, "sample_id")


@query("D8", "SELECT feature_id, sample_id, value, p_brand, p_size FROM bulk JOIN part ON p_partkey = feature_id", "bulk")
def merged_metadata(spark, sf):
    meta = i.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), "p_brand", "p_size")
    return jo.merge_metadata(i.bulk(spark, sf).select("feature_id", "sample_id", "value"), meta, "feature_id")


def families(spark, sf):
    return i.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("set_id"), F.col("s_nationkey").alias("family"))


fragment("sizes", "SELECT set_id, count(*) AS n FROM members GROUP BY set_id", "members")
fragment("pairs", """SELECT set_a, set_b, sa.n AS n_a, sb.n AS n_b, shared, sa.n + sb.n - shared AS joined, shared / (sa.n + sb.n - shared) AS jaccard
FROM (SELECT a.set_id AS set_a, b.set_id AS set_b, count(*) AS shared FROM members a JOIN members b ON a.feature_id = b.feature_id AND a.set_id < b.set_id GROUP BY ALL)
JOIN sizes sa ON sa.set_id = set_a JOIN sizes sb ON sb.set_id = set_b""", "members sizes")
fragment("family_pairs", "SELECT fa.s_nationkey AS family, pairs.* FROM pairs JOIN supplier fa ON fa.s_suppkey = set_a JOIN supplier fb ON fb.s_suppkey = set_b AND fa.s_nationkey = fb.s_nationkey", "pairs")


@query("D9", "SELECT family, set_a, set_b, n_a, n_b, shared, joined, round(jaccard, 6) AS jaccard FROM family_pairs", "family_pairs")
def family_pairs(spark, sf):
    return i.rounded(jo.family_pairs(i.members(spark, sf), families(spark, sf)), "jaccard")


@query("D10", "SELECT set_a, set_b, n_a, n_b, shared, joined, round(jaccard, 6) AS jaccard FROM pairs", "pairs")
def jaccard_matrix(spark, sf):
    return i.rounded(jo.jaccard_matrix(i.members(spark, sf)), "jaccard")


@query("D11", """SELECT g.grp, t.timepoint, c.condition, count(l.feature_id) AS n FROM (SELECT DISTINCT c_mktsegment AS grp FROM customer) g
CROSS JOIN (VALUES ('t1'), ('t2'), ('t3')) t(timepoint) CROSS JOIN (VALUES ('T1'), ('T2'), ('T12')) c(condition)
LEFT JOIN (SELECT * FROM lfc WHERE abs(lfc) > 4) l ON l.grp = g.grp AND l.timepoint = t.timepoint AND l.condition = c.condition GROUP BY ALL""", "lfc")
def comparison_grid(spark, sf):
    counts = i.lfc(spark, sf).where("abs(lfc) > 4").groupBy(*i.COMPARISON).agg(F.count(F.lit(1)).alias("n"))
    grid = jo.comparison_grid(spark, grp=i.GROUPS, timepoint=i.TIMEPOINTS, condition=i.TREATMENTS)
    return grid.join(counts, i.COMPARISON, "left").fillna({"n": 0})


@query("D12", """WITH names AS (SELECT p_name AS name FROM part UNION SELECT p_type FROM part UNION SELECT p_brand FROM part),
hits AS (SELECT lower(p_name) AS q, p_partkey AS position, upper(p_name) AS symbol, p_type AS alias FROM part
  UNION ALL SELECT lower(p_type), p_partkey, p_brand, CASE WHEN p_partkey % 7 = 0 THEN lower(p_type) ELSE 'x' END FROM part)
SELECT name, coalesce((SELECT arg_min(symbol, (CASE WHEN lower(symbol) = lower(name) THEN 0 WHEN lower(alias) = lower(name) THEN 1 ELSE 2 END, position)) FROM hits WHERE q = lower(name)), name) AS symbol FROM names""")
def resolved_symbols(spark, sf):
    part = i.table(spark, sf, "part")
    names = part.select(F.explode(F.array("p_name", "p_type", "p_brand")).alias("name")).distinct()
    by_name = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("position"), F.upper("p_name").alias("symbol"), F.col("p_type").alias("alias"))
    by_type = part.select(F.col("p_type").alias("name"), F.col("p_partkey").alias("position"), F.col("p_brand").alias("symbol"),
                          F.when(F.col("p_partkey") % 7 == 0, F.lower("p_type")).otherwise("x").alias("alias"))
    return jo.resolve_symbols(names, by_name.unionByName(by_type))


@query("D13", """SELECT c_custkey AS user_id, count(event_id) AS n_experiments, count(event_id) > 0 AS expressed FROM customer
LEFT JOIN events ON user_id = c_custkey AND event_type = 'view' AND value >= 5 GROUP BY c_custkey""")
def expression_flags(spark, sf):
    genes = i.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return jo.expression_flags(genes, i.table(spark, sf, "events"), (F.col("event_type") == "view") & (F.col("value") >= 5), "user_id")


@query("D14", "SELECT p_partkey AS feature_id, p_name FROM part WHERE p_partkey IN (SELECT feature_id FROM classes WHERE class = 'up')", "classes")
def restricted_features(spark, sf):
    parts = i.table(spark, sf, "part").select(F.col("p_partkey").alias("feature_id"), "p_name")
    return jo.restrict(parts, i.classes(spark, sf).where("class = 'up'"), "feature_id")


_GRID_SQL = "(VALUES " + ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in GRID) + ") g(pct, max_p, min_lff)"
fragment("grid", f"SELECT * FROM {_GRID_SQL}")
fragment("refiltered", "SELECT s.*, max_p, min_lff FROM sweep_enriched s JOIN grid g ON s.pct = g.pct AND s.p <= max_p AND abs(s.lff) >= min_lff", "sweep_enriched grid")


@query("D15", "SELECT pct, max_p, min_lff, grp, timepoint, condition, set_id, direction FROM refiltered", "refiltered")
def refiltered_grid(spark, sf):
    return grids.hits(i.sweep(spark, sf), GRID, "p").select("pct", "max_p", "min_lff", *i.COMPARISON, "set_id", "direction")


@query("G1", """SELECT grp, timepoint, condition, set_id, change FROM (
  SELECT grp, timepoint, condition, set_id, 'gained' AS change FROM sweep_enriched WHERE pct = 10 AND p <= 0.201
    AND (grp, timepoint, condition, set_id) NOT IN (SELECT (grp, timepoint, condition, set_id) FROM sweep_enriched WHERE pct = 5 AND p <= 0.201)
  UNION ALL SELECT grp, timepoint, condition, set_id, 'lost' FROM sweep_enriched WHERE pct = 5 AND p <= 0.201
    AND (grp, timepoint, condition, set_id) NOT IN (SELECT (grp, timepoint, condition, set_id) FROM sweep_enriched WHERE pct = 10 AND p <= 0.201))""", "sweep_enriched")
def gained_and_lost(spark, sf):
    hits = i.sweep(spark, sf).where("p <= 0.201")
    return jo.gained_lost(hits.where("pct = 5"), hits.where("pct = 10"), [*i.COMPARISON, "set_id"])


@query("G2", "SELECT set_id FROM hits WHERE direction = '-' AND timepoint = 't2' INTERSECT SELECT set_id FROM hits WHERE direction = '+' AND timepoint = 't3'", "hits")
def intersected_hits(spark, sf):
    hits = i.results(spark, sf).where("tier = 'significant'")
    return jo.intersect_sets(hits.where("direction = '-' AND timepoint = 't2'"), hits.where("direction = '+' AND timepoint = 't3'"), "set_id")


@query("G3", "SELECT set_id FROM hits WHERE timepoint = 't2' GROUP BY set_id HAVING count(DISTINCT condition) = 3", "hits")
def hit_in_all_conditions(spark, sf):
    hits = i.results(spark, sf).where("tier = 'significant' AND timepoint = 't2'")
    return jo.hit_in_all(hits, "set_id", "condition", i.TREATMENTS)


@query("G4", "SELECT feature_id FROM classes WHERE class = 'up' UNION SELECT feature_id FROM classes WHERE class = 'down'", "classes")
def union_of_sides(spark, sf):
    df = i.classes(spark, sf)
    return jo.union_distinct(df.where("class = 'up'"), df.where("class = 'down'"), "feature_id")


@query("G5", """SELECT source, grp, timepoint, condition, set_id, n_members::DOUBLE AS n_members FROM (SELECT 'sig' AS source, grp, timepoint, condition, set_id, n_members FROM results WHERE tier = 'significant'
  UNION ALL SELECT 'tested', grp, timepoint, condition, set_id, NULL FROM enriched)""", "results")
def stacked_results(spark, sf):
    res = i.results(spark, sf)
    sig = res.where("tier = 'significant'").select(F.lit("sig").alias("source"), *i.COMPARISON, "set_id", F.col("n_members").cast("double").alias("n_members"))
    return jo.stack([sig, res.select(F.lit("tested").alias("source"), *i.COMPARISON, "set_id")])
