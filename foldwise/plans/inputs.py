"""The test tables seen as the long measurement model, and the same as SQL fragments.

feature = part, set = supplier, control/treatments = order priorities,
timepoint = order year, gender = line status, group = customer segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.operators import enrichment as en
from foldwise.plans.registry import FRAGMENTS, fragment
from foldwise.session import staged

CONDITIONS = ["C", "T1", "T2", "T12"]
TREATMENTS = ["T1", "T2", "T12"]
TIMEPOINTS = ["t1", "t2", "t3"]
GROUPS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITY = {"5-LOW": "C", "1-URGENT": "T1", "2-HIGH": "T2", "3-MEDIUM": "T12"}
COMPARISON = ["grp", "timepoint", "condition"]
CONTEXT = ["grp", "timepoint"]
SET_RANK = 5
# The tables are near-null, so the named queries judge raw p with a loose bound.
# Exact p values are often round fractions; the bounds are not, so that no row
# sits on a bound up to rounding.
P_HIT = 0.301
P_SHOWN = 0.501


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column) -> Column:
    """Six decimals, without a negative zero."""
    return F.round(column if isinstance(column, Column) else F.col(column), 6) + F.lit(0.0)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its condition, timepoint, gender and group."""
    condition = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    year = F.year("o_orderdate")
    orders = (
        table(spark, sf_dir, "orders")
        .where(F.col("o_orderpriority") != "4-NOT SPECIFIED")
        .select(
            "o_orderkey", "o_custkey",
            condition[F.col("o_orderpriority")].alias("condition"),
            F.when(year <= 1996, "t1").when(year <= 1998, "t2").otherwise("t3").alias("timepoint"),
        )
        .join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp")), "o_custkey")
        .drop("o_custkey")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("feature_id"),
        F.col("l_linestatus").alias("gender"), "l_quantity",
    )
    return lines.join(orders, "o_orderkey").drop("o_orderkey")


fragment("base", """
SELECT l_partkey AS feature_id, l_linestatus AS gender, l_quantity, c_mktsegment AS grp,
  CASE o_orderpriority WHEN '5-LOW' THEN 'C' WHEN '1-URGENT' THEN 'T1' WHEN '2-HIGH' THEN 'T2' ELSE 'T12' END AS condition,
  CASE WHEN year(o_orderdate) <= 1996 THEN 't1' WHEN year(o_orderdate) <= 1998 THEN 't2' ELSE 't3' END AS timepoint
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority <> '4-NOT SPECIFIED'""")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value per (feature, group, timepoint, condition)."""
    return staged(spark, ("cells", sf_dir), lambda: _cell_sums(base(spark, sf_dir)))


def _cell_sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy("feature_id", "grp", "timepoint", "condition").agg(F.sum("l_quantity").alias("value"))


fragment("cells", "SELECT feature_id, grp, timepoint, condition, sum(l_quantity) AS value FROM base GROUP BY ALL", "base")


def bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value per (feature, sample); a sample is gender x timepoint x condition (24 of them)."""
    return staged(spark, ("bulk", sf_dir), lambda: base(spark, sf_dir)
                  .groupBy("feature_id", "gender", "timepoint", "condition").agg(F.sum("l_quantity").alias("value"))
                  .withColumn("sample_id", F.concat_ws("_", "gender", "timepoint", "condition")))


fragment("bulk", """SELECT feature_id, gender, timepoint, condition, sum(l_quantity) AS value,
  gender || '_' || timepoint || '_' || condition AS sample_id
FROM base GROUP BY ALL""", "base")


def plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value per (feature, timepoint, condition): 12 samples, mostly complete."""
    return staged(spark, ("plain", sf_dir), lambda: bulk(spark, sf_dir)
                  .groupBy("feature_id", "timepoint", "condition").agg(F.sum("value").alias("value")))


fragment("plain", "SELECT feature_id, timepoint, condition, sum(value) AS value FROM bulk GROUP BY ALL", "bulk")


def deconvoluted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value per (feature, group, sample)."""
    return staged(spark, ("deconvoluted", sf_dir), lambda: base(spark, sf_dir)
                  .groupBy("feature_id", "grp", "gender", "timepoint", "condition").agg(F.sum("l_quantity").alias("value"))
                  .withColumn("sample_id", F.concat_ws("_", "gender", "timepoint", "condition")))


fragment("decon", """SELECT feature_id, grp, gender, timepoint, condition, sum(l_quantity) AS value,
  gender || '_' || timepoint || '_' || condition AS sample_id
FROM base GROUP BY ALL""", "base")


def lfc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold changes; lines are dealt by the keys of these and added up there, without sums of the cells in between."""
    keys = ["feature_id", "grp", "timepoint"]
    return staged(spark, ("lfc", sf_dir), lambda: en.fold_changes(
        base(spark, sf_dir).repartition(*keys), keys, "condition", "C", TREATMENTS, "l_quantity", summed=True))


fragment("lfc", """
SELECT f.feature_id, f.grp, f.timepoint, f.condition, log2((f.value + 1) / (c.value + 1)) AS lfc
FROM cells f JOIN cells c ON f.feature_id = c.feature_id AND f.grp = c.grp AND f.timepoint = c.timepoint AND c.condition = 'C'
WHERE f.condition <> 'C'""", "cells")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, ("classes", sf_dir), lambda: en.classify_sites(
        en.foreground_gate(lfc(spark, sf_dir), COMPARISON), COMPARISON))


fragment("gated", """
SELECT * FROM lfc SEMI JOIN (SELECT grp, timepoint, condition FROM lfc GROUP BY ALL
  HAVING quantile_cont(abs(lfc), 0.95) >= 0.1) g USING (grp, timepoint, condition)""", "lfc")
fragment("classes", """
SELECT * EXCLUDE (r), CASE WHEN r <= k THEN 'down' WHEN r > n - k THEN 'up' ELSE 'bg' END AS class
FROM (SELECT *, CAST(floor(n * 5.0 / 100) AS BIGINT) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY grp, timepoint, condition ORDER BY lfc, feature_id) AS r,
    count(*) OVER (PARTITION BY grp, timepoint, condition) AS n FROM gated))""", "gated")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a set for a feature: money of the supplier's lines for the part, in cents.

    Lines are dealt by feature, which serves the sums and the ranks of a feature's sets alike.
    """
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    return (table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("feature_id"), F.col("l_suppkey").alias("set_id"), "l_extendedprice")
            .repartition("feature_id").groupBy("feature_id", "set_id").agg(cents.alias("score")))


fragment("scores", """SELECT l_partkey AS feature_id, l_suppkey AS set_id,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS score FROM lineitem GROUP BY ALL""")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, ("members", sf_dir), lambda: en.members_from_scores(scores(spark, sf_dir), rank_k=SET_RANK))


fragment("members", """SELECT feature_id, set_id FROM (SELECT *, row_number() OVER (PARTITION BY feature_id
  ORDER BY score DESC, set_id) AS r FROM scores) WHERE r <= 5""", "scores")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrichment table: one row per (comparison, set)."""

    def build() -> DataFrame:
        scored = en.enrich(classes(spark, sf_dir), members(spark, sf_dir), COMPARISON)
        stats = en.substrate_stats(classes(spark, sf_dir), members(spark, sf_dir), scored, COMPARISON, p_col="p", p_sig=1.0, lff_min=0.0)
        return en.significance_tier(en.attach_evidence(scored, stats, COMPARISON), COMPARISON, p_col="p", p_sig=P_HIT, p_display=P_SHOWN)

    return staged(spark, ("results", sf_dir), build)


fragment("counts", """
SELECT grp, timepoint, condition, set_id, any_value(k) AS n_up, any_value(k) AS n_down, any_value(n) - 2 * any_value(k) AS n_bg,
  count(*) FILTER (class = 'up') AS a_up, count(*) FILTER (class = 'down') AS a_down, count(*) FILTER (class = 'bg') AS c
FROM classes JOIN members USING (feature_id) GROUP BY grp, timepoint, condition, set_id""", "classes members")


def _tail_sql(a: str, n: str) -> str:
    hits, total = f"({a} + c)", f"({n} + n_bg)"
    ln = lambda x: f"lgamma(({x}) + 1.0)"
    terms = (f"{ln(hits)} + {ln(f'{total} - {hits}')} + {ln(n)} + {ln(f'{total} - {n}')} - {ln(total)} - {ln('x')} - {ln(f'{hits} - x')}"
             f" - {ln(f'{n} - x')} - {ln(f'{total} - {hits} - {n} + x')}")
    tail = f"(SELECT sum(exp({terms})) FROM generate_series({a}, least({hits}, {n})) g(x))"
    return f"(CASE WHEN {a} <= greatest(0, {hits} + {n} - {total}) THEN 1.0::DOUBLE ELSE least(1.0, {tail}) END)"


def _factor_sql(a: str, n: str) -> str:
    add = f"(CASE WHEN {a} = 0 OR {a} = {n} OR c = 0 OR c = n_bg THEN 0.5::DOUBLE ELSE 0 END)"
    return f"log2((({a} + {add}) / ({n} + 2 * {add})) / ((c + {add}) / (n_bg + 2 * {add})))"


fragment("tails", f"SELECT *, {_tail_sql('a_up', 'n_up')} AS p_up, {_tail_sql('a_down', 'n_down')} AS p_down FROM counts", "counts")
fragment("scored", f"""
SELECT *, CASE WHEN p_up <= p_down * (1 + 1e-9) THEN '+' ELSE '-' END AS direction, least(p_up, p_down) AS p,
  CASE WHEN p_up <= p_down * (1 + 1e-9) THEN {_factor_sql('a_up', 'n_up')} ELSE -{_factor_sql('a_down', 'n_down')} END AS lff
FROM tails""", "tails")
fragment("enriched", """
SELECT * EXCLUDE (r, m, q), least(1.0, min(q) OVER (PARTITION BY grp, timepoint, condition ORDER BY r DESC
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adj_p
FROM (SELECT *, p * m / r AS q FROM (SELECT *, count(*) OVER (PARTITION BY grp, timepoint, condition) AS m,
  row_number() OVER (PARTITION BY grp, timepoint, condition ORDER BY p, set_id) AS r FROM scored))""", "scored")
fragment("hit_members", """
SELECT c.grp, c.timepoint, c.condition, e.set_id, c.feature_id, c.class, c.lfc
FROM classes c JOIN members USING (feature_id) JOIN enriched e ON e.grp = c.grp AND e.timepoint = c.timepoint
  AND e.condition = c.condition AND e.set_id = members.set_id
WHERE c.class = CASE WHEN e.direction = '-' THEN 'down' ELSE 'up' END""", "classes members enriched")
fragment("results", f"""
SELECT *, CASE WHEN abs(lff) >= 0.01 AND p <= {P_HIT} THEN 'significant'
  WHEN (lff >= lff_high - 1e-9 OR lff <= lff_low + 1e-9) AND p < 0.501 THEN 'display' ELSE 'non_significant' END AS tier
FROM enriched LEFT JOIN (
  SELECT grp, timepoint, condition, set_id, count(*) AS n_members, quantile_cont(abs(lfc), 0.5) AS median_lfc,
    quantile_cont(abs(lfc), 0.75) AS q75_lfc, max(abs(lfc)) AS max_lfc,
    CASE WHEN quantile_cont(abs(lfc), 0.5) >= 0.75 THEN 'Strong' WHEN quantile_cont(abs(lfc), 0.5) >= 0.5 THEN 'Moderate' ELSE 'Subtle' END AS evidence
  FROM hit_members GROUP BY ALL) s USING (grp, timepoint, condition, set_id)
JOIN (SELECT grp, timepoint, condition, quantile_cont(lff, 0.05) AS lff_low, quantile_cont(lff, 0.95) AS lff_high
  FROM enriched GROUP BY ALL) t USING (grp, timepoint, condition)""", "enriched hit_members")


SWEEP_PCTS = [2.5, 5.0, 10.0]


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The enrichment table at several class shares."""

    def build() -> DataFrame:
        by = ["pct", *COMPARISON]
        return en.enrich(en.classify_at(lfc(spark, sf_dir), COMPARISON, SWEEP_PCTS, nested=True), members(spark, sf_dir), by, SWEEP_PCTS)

    return staged(spark, ("sweep", sf_dir), build)


fragment("sweep_classes", """
SELECT * EXCLUDE (r), CASE WHEN r <= k THEN 'down' WHEN r > n - k THEN 'up' ELSE 'bg' END AS class
FROM (SELECT *, CAST(floor(n * pct / 100) AS BIGINT) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY grp, timepoint, condition ORDER BY lfc, feature_id) AS r,
    count(*) OVER (PARTITION BY grp, timepoint, condition) AS n FROM lfc) CROSS JOIN (VALUES (2.5::DOUBLE), (5), (10)) v(pct))""", "lfc")
for _name, _parent in [("counts", "classes"), ("tails", "counts"), ("scored", "tails"), ("enriched", "scored")]:
    _sql = FRAGMENTS[_name][1].replace("grp, timepoint, condition", "pct, grp, timepoint, condition")
    _sql = _sql.replace(f"FROM {_parent}", f"FROM sweep_{_parent}")
    fragment(f"sweep_{_name}", _sql, f"sweep_{_parent} members")


def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldwise.operators.joins import condition_triplets

    return staged(spark, ("triplets", sf_dir), lambda: condition_triplets(
        results(spark, sf_dir), CONTEXT, TREATMENTS, p_col="p", p_sig=P_HIT))


fragment("triplets", f"""
SELECT grp, timepoint, set_id, {', '.join(
    f"max(lff) FILTER (condition = '{t}') AS lff_{t}, max(p) FILTER (condition = '{t}') AS p_{t}, max(direction) FILTER (condition = '{t}') AS dir_{t}, "
    f"max(n_members) FILTER (condition = '{t}') AS n_{t}, max(median_lfc) FILTER (condition = '{t}') AS median_{t}, "
    f"max(p) FILTER (condition = '{t}') < {P_HIT} AS sig_{t}" for t in TREATMENTS)},
  lff_T1 + lff_T2 AS lff_sum, lff_T12 - (lff_T1 + lff_T2) AS lff_residual
FROM results SEMI JOIN (SELECT grp, timepoint FROM results GROUP BY ALL HAVING count(DISTINCT condition) = 3) x USING (grp, timepoint)
GROUP BY grp, timepoint, set_id HAVING count(*) FILTER (condition = 'T1') > 0""", "results")


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression per (group, sample, gene); a gene is a part's brand and type."""

    def build() -> DataFrame:
        part = table(spark, sf_dir, "part").select(
            F.col("p_partkey").alias("feature_id"), F.concat_ws("-", "p_brand", "p_type").alias("gene"))
        rows = base(spark, sf_dir).join(part, "feature_id").withColumn("sample_id", F.concat_ws("_", "gender", "timepoint", "condition"))
        return rows.groupBy("grp", "sample_id", "condition", "gene").agg(F.sum("l_quantity").alias("value"))

    return staged(spark, ("expression", sf_dir), build)


fragment("expression", """SELECT grp, sample_id, condition, p_brand || '-' || p_type AS gene, sum(value) AS value
FROM decon JOIN part ON p_partkey = feature_id GROUP BY ALL""", "decon")
