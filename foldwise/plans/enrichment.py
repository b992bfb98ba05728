"""Fold changes, classes, enrichment, corrections and tiers."""

from __future__ import annotations

from foldwise.operators import enrichment as en
from foldwise.plans import inputs as i
from foldwise.plans.registry import fragment, query


@query("B1", "SELECT feature_id, grp, timepoint, condition, round(lfc, 6) AS lfc FROM lfc", "lfc")
def log2_fold_change(spark, sf):
    return i.rounded(i.lfc(spark, sf), "lfc").select("feature_id", "grp", "timepoint", "condition", "lfc")


@query("C1", "SELECT feature_id, grp, timepoint, condition, round(lfc, 6) AS lfc FROM gated", "gated")
def foreground_gate(spark, sf):
    return i.rounded(en.foreground_gate(i.lfc(spark, sf), i.COMPARISON), "lfc").select("feature_id", "grp", "timepoint", "condition", "lfc")


@query("F10", "SELECT feature_id, grp, timepoint, condition, class, n, k FROM classes", "classes")
def classify_sites(spark, sf):
    return i.classes(spark, sf).select("feature_id", "grp", "timepoint", "condition", "class", "n", "k")


@query("H2", "SELECT feature_id, set_id FROM members", "members")
def set_members(spark, sf):
    return i.members(spark, sf)


@query("H1", "SELECT grp, timepoint, condition, set_id, a_up, a_down, c, n_up, n_bg, direction, round(lff, 6) AS lff, round(p, 6) AS p, round(adj_p, 6) AS adj_p FROM enriched", "enriched")
def set_enrichment(spark, sf):
    df = en.enrich(i.classes(spark, sf), i.members(spark, sf), i.COMPARISON)
    return i.rounded(df, "lff", "p", "adj_p").select(
        "grp", "timepoint", "condition", "set_id", "a_up", "a_down", "c", "n_up", "n_bg", "direction", "lff", "p", "adj_p")


fragment("threshold_counts", """SELECT *, n - n_up - n_down AS n_bg FROM (
  SELECT grp, timepoint, condition, count(*) AS n, count(*) FILTER (lfc >= 2) AS n_up, count(*) FILTER (lfc <= -2) AS n_down FROM gated GROUP BY ALL)
JOIN (SELECT grp, timepoint, condition, set_id, count(*) FILTER (lfc >= 2) AS a_up, count(*) FILTER (lfc <= -2) AS a_down, count(*) FILTER (abs(lfc) < 2) AS c
  FROM gated JOIN members USING (feature_id) GROUP BY ALL) USING (grp, timepoint, condition)""", "gated members")
fragment("threshold_tails", f"SELECT *, {i._tail_sql('a_up', 'n_up')} AS p_up, {i._tail_sql('a_down', 'n_down')} AS p_down FROM threshold_counts", "threshold_counts")
fragment("threshold_scored", """SELECT *, CASE WHEN p_up <= p_down * (1 + 1e-9) THEN '+' ELSE '-' END AS direction, least(p_up, p_down) AS p FROM threshold_tails""", "threshold_tails")


@query("H1", f"""SELECT grp, timepoint, condition, set_id, a_up, a_down, c, n_up, n_down, n_bg, direction, round(p, 6) AS p,
  round(CASE WHEN direction = '+' THEN {i._factor_sql('a_up', 'n_up')} ELSE -{i._factor_sql('a_down', 'n_down')} END, 6) + 0 AS lff FROM threshold_scored""", "threshold_scored")
def threshold_enrichment(spark, sf):
    """Sides by a fixed fold change, so the two differ in size."""
    gated = en.foreground_gate(i.lfc(spark, sf), i.COMPARISON)
    df = en.enrich(en.classify_by_threshold(gated, i.COMPARISON, 2.0), i.members(spark, sf), i.COMPARISON)
    return i.rounded(df, "lff", "p").select("grp", "timepoint", "condition", "set_id", "a_up", "a_down", "c", "n_up", "n_down", "n_bg", "direction", "lff", "p")
