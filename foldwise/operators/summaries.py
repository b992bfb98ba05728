"""Summaries of the enrichment table: counts, rankings, sweeps and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.operators import grids
from foldwise.operators.enrichment import LFF_MIN, P_SIG, significant
from foldwise.operators.joins import stack
from foldwise.operators.keys import join_same
from foldwise.operators.ordering import ranked, running, sized
from foldwise.session import bounded, written

P_FLOOR = 1e-300


def evidence(p: Column) -> Column:
    """-log10 p with p floored away from zero."""
    return -F.log10(F.greatest(p, F.lit(P_FLOOR)))


def distinct_list(column: str, sep: str = ", ") -> Column:
    """Sorted distinct values as text; for columns with few values (groups, conditions)."""
    return F.array_join(F.sort_array(F.collect_set(column)), sep)


def comparison_summary(
    results: DataFrame, by: Sequence[str], p_col: str = "adj_p", p_sig: float = P_SIG, lff_min: float = LFF_MIN
) -> DataFrame:
    """Hits, sets tested and mean |lff| per comparison."""
    return results.groupBy(*by).agg(
        F.count_if(significant(F.col(p_col), F.col("lff"), p_sig, lff_min)).alias("n_sig"),
        F.count(F.lit(1)).alias("n_tested"),
        F.avg(F.abs("lff")).alias("mean_abs_lff"),
    )


def set_summary(results: DataFrame) -> DataFrame:
    """Per set over its significant rows."""
    return results.where("tier = 'significant'").groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_sig"),
        F.avg(F.abs("lff")).alias("mean_abs_lff"),
        F.mode("direction", True).alias("direction"),
        distinct_list("grp").alias("groups"),
        F.avg("median_lfc").alias("mean_median_lfc"),
        F.coalesce(F.mode("evidence", True), F.lit("unknown")).alias("evidence"),
    )


def result_table(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """All rows with their labels, in reading order."""
    columns = ["direction", "lff", "p", "adj_p", "tier", "n_members", "median_lfc", "q75_lfc", "max_lfc", "evidence"]
    return results.select(*by, "set_id", *columns).orderBy("grp", "set_id", "timepoint", "condition")


def correction_recovery(
    results: DataFrame, by: Sequence[str], first: str, second: str, p_sig: float = P_SIG, lff_min: float = LFF_MIN, names: int = 10
) -> DataFrame:
    """Hits under two corrections per comparison, with the first ``names`` gained and lost sets.

    The name lists come from a top-k window, so no comparison's full hit list is collected.
    """
    strong = F.abs("lff") >= lff_min
    rows = results.withColumn("_a", strong & (F.col(first) <= p_sig)).withColumn("_b", strong & (F.col(second) <= p_sig))
    change = F.when(F.col("_b") & ~F.col("_a"), "gained").when(F.col("_a") & ~F.col("_b"), "lost")
    rows = rows.withColumn("_change", change)
    counts = rows.groupBy(*by).agg(
        F.count_if("_a").alias("n_first"), F.count_if("_b").alias("n_second"),
        F.count_if(F.col("_change") == "gained").alias("n_gained"), F.count_if(F.col("_change") == "lost").alias("n_lost"),
    ).withColumn("net_change", F.col("n_gained") - F.col("n_lost"))
    order = Window.partitionBy(*by, "_change").orderBy("set_id")
    top = rows.where("_change IS NOT NULL").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= names)
    text = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("_change") == kind, F.col("set_id")))).cast("array<string>"), ", ")
    lists = top.groupBy(*by).agg(text("gained").alias("gained"), text("lost").alias("lost"))
    joined = counts.join(lists, list(by), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("gained", "lost")})


def recovered_sets(results: DataFrame, first: str, second: str, p_sig: float = P_SIG, lff_min: float = LFF_MIN) -> DataFrame:
    """Sets that are hits under the second correction but not under the first."""
    gained = results.where((F.abs("lff") >= lff_min) & (F.col(second) <= p_sig) & (F.col(first) > p_sig))
    return gained.groupBy("set_id").agg(
        F.count(F.lit(1)).alias("n_recovered"), distinct_list("condition").alias("conditions"), distinct_list("timepoint").alias("timepoints"),
        F.count_distinct("grp").alias("n_groups"), F.avg("lff").alias("mean_lff"), F.avg(F.abs("lff")).alias("mean_abs_lff"),
        F.avg("p").alias("mean_p"), F.avg(first).alias("mean_first"), F.avg(second).alias("mean_second"),
    )


def correction_pairs(results: DataFrame, first: str, second: str, p_sig: float = P_SIG) -> DataFrame:
    """-log10 of both corrected p values, and the quadrant of each row."""
    a, b = F.col(first) <= p_sig, F.col(second) <= p_sig
    quadrant = F.when(a & b, "both").when(b, "gained").when(a, "lost").otherwise("neither")
    return results.withColumn("first_score", evidence(F.col(first))).withColumn("second_score", evidence(F.col(second))).withColumn("quadrant", quadrant)


def mean_sem(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and standard error of the mean."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("mean"), (F.stddev(value) / F.sqrt(F.count(value))).alias("sem"), F.count(value).alias("n"))


def direction_counts(results: DataFrame, keys: Sequence[str], distinct: bool = True) -> DataFrame:
    """Sets (or rows) per key and direction; the down side is negative."""
    counted = F.count_distinct("set_id") if distinct else F.count(F.lit(1))
    counts = results.groupBy(*keys, "direction").agg(counted.alias("n"))
    return counts.withColumn("n", F.when(F.col("direction") == "-", -F.col("n")).otherwise(F.col("n")))


def hit_counts(results: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """Row counts as a table with a column per value; gaps are 0."""
    return results.groupBy(*rows).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0)


def threshold_sweep(results: DataFrame, grid: DataFrame | Sequence[tuple[float, float, float]], p_col: str = "adj_p") -> DataFrame:
    """Hits, distinct sets and comparisons with hits at every grid cell, empty cells included."""
    cells = grids.grid_of(results.sparkSession, grid)
    rows = grids.placed(results, cells, p_col)
    every = F.lit(True)
    places = [
        grids.row_counts(rows, {"total_hits": every}),
        grids.key_counts(rows, ["set_id"], {"n_sets": [every]}),
        grids.key_counts(rows, ["grp", "timepoint", "condition"], {"n_comparisons": [every]})]
    return _at_cells(cells, places, ["total_hits", "n_sets", "n_comparisons"])


def _at_cells(cells: DataFrame, places: Sequence[DataFrame], names: Sequence[str]) -> DataFrame:
    """Several tables of places, each with some of the names, as counts at the cells."""
    whole = stack(places).fillna(0, list(names)).groupBy("pct", "_i", "_j").agg(*[F.sum(n).alias(n) for n in names])
    return grids.at_cells(cells, whole, names).fillna(0, list(names))


def core_claims(
    results: DataFrame, grid: DataFrame | Sequence[tuple[float, float, float]], conditions: Sequence[str], middle: str, late: str, focus: str, p_col: str = "adj_p"
) -> DataFrame:
    """Per grid cell: sets hit in all conditions at ``middle``; sets of ``focus`` down at
    ``middle`` and up at ``late``; percent down and percent up there (null without hits)."""
    cells = grids.grid_of(results.sparkSession, grid)
    rows = grids.placed(results, cells, p_col)
    at_middle, at_late = F.col("timepoint") == middle, F.col("timepoint") == late
    of_focus, up, down = F.col("condition") == focus, F.col("direction") == "+", F.col("direction") == "-"
    counted = {"_n_mid": of_focus & at_middle, "_n_down": of_focus & at_middle & down, "_n_late": of_focus & at_late, "_n_up": of_focus & at_late & up}
    places = [
        grids.row_counts(rows, counted),
        grids.key_counts(rows, ["set_id"], {
            "n_shared": [at_middle & (F.col("condition") == c) for c in conditions],
            "n_reversed": [of_focus & at_middle & down, of_focus & at_late & up]})]
    table = _at_cells(cells, places, ["n_shared", "n_reversed", *counted])
    return table.select(
        *grids.CELL, "n_shared", "n_reversed",
        (F.try_divide(F.col("_n_down"), F.col("_n_mid")) * 100).alias("pct_down"), (F.try_divide(F.col("_n_up"), F.col("_n_late")) * 100).alias("pct_up"))


def family_overlap_summary(pairs: DataFrame, members: DataFrame, families: DataFrame) -> DataFrame:
    """Mean, largest and smallest Jaccard index per family, and how redundant its members are.

    Pairs that share nothing are absent from ``pairs``; they count as 0.
    Families with fewer than two non-empty sets are left out.
    """
    held = members.select("feature_id", "set_id").distinct().join(families, "set_id")
    sets = held.groupBy("family", "set_id").agg(F.count(F.lit(1)).alias("_n")).groupBy("family").agg(
        F.count(F.lit(1)).alias("n_sets"), F.sum("_n").alias("total_members"))
    unique = held.groupBy("family", "feature_id").agg(F.first("set_id").alias("_s")).groupBy("family").agg(F.count(F.lit(1)).alias("unique_members"))
    seen = pairs.groupBy("family").agg(
        F.sum("jaccard").alias("_sum"), F.max("jaccard").alias("_max"), F.min("jaccard").alias("_min"), F.count(F.lit(1)).alias("_pairs"))
    rows = sets.where("n_sets > 1").join(unique, "family").join(seen, "family", "left")
    every = F.col("n_sets") * (F.col("n_sets") - 1) / 2
    return rows.select(
        "family", "n_sets", (F.coalesce("_sum", F.lit(0.0)) / every).alias("mean_jaccard"), F.coalesce("_max", F.lit(0.0)).alias("max_jaccard"),
        F.when(F.coalesce("_pairs", F.lit(0)) < every, 0.0).otherwise(F.col("_min")).alias("min_jaccard"),
        "unique_members", "total_members", (1 - F.col("unique_members") / F.col("total_members")).alias("redundancy"))


# ---- rankings ---------------------------------------------------------------

def rank_sets(results: DataFrame, conditions: Sequence[str], per_group: bool = False, tie: str = "set_id") -> DataFrame:
    """Rank all sets over their comparisons, globally or within each group.

    Order: significant comparisons, comparisons tested, mean |lff|; then set id.
    """
    keys = ["grp"] if per_group else []
    table = results.groupBy(*keys, "set_id").agg(*_rank_columns(conditions))
    groups = F.lit(1).cast("long") if per_group else F.col("_groups")
    if not per_group:
        table = _with_groups(table, results)
    return ranked(_rank_table(table, [*keys, "set_id"], groups, conditions), keys, _rank_order(tie), "rank")


def rank_levels(results: DataFrame, conditions: Sequence[str], tie: str = "set_id") -> DataFrame:
    """Both rankings in one table, from one aggregation by grouping sets: ``level`` is 'all' or 'group', ``grp`` null for all."""
    # A grouping column is null where its level leaves it out, so the groups are counted on a copy.
    rows = results.withColumn("_grp", F.col("grp"))
    table = rows.groupingSets([[F.col("set_id")], [F.col("grp"), F.col("set_id")]], F.col("grp"), F.col("set_id")).agg(
        F.grouping("grp").alias("_all"), *_rank_columns(conditions, "_grp"))
    table = _with_groups(table, results).withColumn("level", F.when(F.col("_all") == 1, "all").otherwise("group"))
    groups = F.when(F.col("_all") == 1, F.col("_groups")).otherwise(F.lit(1))
    return ranked(_rank_table(table, ["level", "grp", "set_id"], groups, conditions), ["level", "grp"], _rank_order(tie), "rank")


def _with_groups(table: DataFrame, results: DataFrame) -> DataFrame:
    """The number of groups beside every row, counted in the same plan."""
    one = results.agg(F.count_distinct("grp").alias("_groups"), F.lit(0).alias("_one"))
    return table.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").drop("_one")  # one row


def _rank_columns(conditions: Sequence[str], grp: str = "grp") -> list[Column]:
    hit = F.col("tier") == "significant"
    return [
        F.max(F.when(hit, 2).when(F.col("tier") == "display", 1).otherwise(0)).alias("_tier"),
        F.count_if(hit).alias("n_sig"), F.count(F.lit(1)).alias("n_total"),
        F.size(F.collect_set(F.when(hit, F.col(grp)))).alias("_sig"), F.size(F.collect_set(grp)).alias("_held"),
        distinct_list(grp).alias("group_list"), distinct_list("timepoint").alias("timepoints"), distinct_list("condition").alias("conditions"),
        F.avg(F.abs("lff")).alias("mean_abs_lff"), F.min("p").alias("best_p"),
        *[F.avg(F.when(F.col("condition") == c, F.col("lff"))).alias(f"lff_{c}") for c in conditions]]


def _rank_table(table: DataFrame, keys: Sequence[str], n_groups: Column, conditions: Sequence[str]) -> DataFrame:
    coverage = lambda c: F.concat_ws("/", F.col(c).cast("string"), n_groups.cast("string"))
    return table.select(
        *keys, F.element_at(F.array(F.lit("non_significant"), F.lit("display"), F.lit("significant")), F.col("_tier") + 1).alias("tier"),
        "n_sig", "n_total", coverage("_sig").alias("groups_sig"), coverage("_held").alias("groups_total"),
        "group_list", "timepoints", "conditions", "mean_abs_lff", "best_p", *[f"lff_{c}" for c in conditions])


def _rank_order(tie: str) -> list[Column]:
    # Equal means may differ in the last bits between plans; the order uses six decimals.
    return [F.col("n_sig").desc(), F.col("n_total").desc(), F.round("mean_abs_lff", 6).desc(), F.col(tie)]


def top_by_abs(results: DataFrame, by: Sequence[str], n: int, value: str = "lff", tie: str = "set_id") -> DataFrame:
    """The ``n`` largest |value| per comparison (a top-k window)."""
    order = Window.partitionBy(*by).orderBy(F.round(F.abs(value), 6).desc(), F.col(tie))
    return results.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def display_order(results: DataFrame, families: DataFrame) -> DataFrame:
    """Sets in display order: by family, then mean |lff| from high to low."""
    means = results.groupBy("set_id").agg(F.avg(F.abs("lff")).alias("mean_abs_lff"))
    rows = means.join(families, "set_id", "left").withColumn("family", F.coalesce(F.col("family").cast("string"), F.lit("Other")))
    return ranked(rows, [], [F.col("family"), F.round("mean_abs_lff", 6).desc(), F.col("set_id")], "position")


def temporal_table(results: DataFrame, timepoints: Sequence[str], p_col: str = "adj_p", p_sig: float = P_SIG, lff_min: float = LFF_MIN) -> DataFrame:
    """Significance, direction and lff at each timepoint, for rows significant at any."""
    picks = []
    for t in timepoints:
        here = F.col("timepoint") == t
        picks += [
            F.coalesce(F.bool_or(F.when(here, significant(F.col(p_col), F.col("lff"), p_sig, lff_min))), F.lit(False)).alias(f"sig_{t}"),
            F.coalesce(F.max(F.when(here, F.col("direction"))), F.lit("")).alias(f"direction_{t}"),
            F.max(F.when(here, F.col("lff"))).alias(f"lff_{t}"),
        ]
    table = results.groupBy("set_id", "condition", "grp").agg(*picks)
    any_hit = F.col(f"sig_{timepoints[0]}")
    for t in timepoints[1:]:
        any_hit = any_hit | F.col(f"sig_{t}")
    return table.where(any_hit)


# ---- concentration of evidence ----------------------------------------------

def gini(df: DataFrame, by: Sequence[str], value: str, tie: str = "set_id", fits: bool | None = None) -> DataFrame:
    """Gini coefficient per group; null when the total is 0."""
    rows = ranked(df, by, [F.col(value), F.col(tie)], "_i", fits)
    n, total, weighted = F.count(F.lit(1)), F.sum(value), F.sum(F.col("_i") * F.col(value))
    return rows.groupBy(*by).agg(F.try_divide(2 * weighted - (n + 1) * total, n * total).alias("gini"))


def top_k_share(df: DataFrame, by: Sequence[str], value: str, k: int, tie: str = "set_id") -> DataFrame:
    """Share of the total held by the ``k`` largest values."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie))
    top = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy(*by).agg(F.sum(value).alias("_top"))
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return join_same(totals, top, by).select(*by, F.try_divide(F.col("_top"), F.col("_total")).alias(f"top{k}_share"))


def lorenz(df: DataFrame, by: Sequence[str], value: str, tie: str = "set_id") -> DataFrame:
    """Lorenz curve points per group with the origin; the diagonal when the total is 0."""
    by = list(by)
    df, fits = sized(df, by)
    rows = ranked(df, by, [F.col(value), F.col(tie)], "_i", fits)
    rows = running(rows, by, "_i", F.col(value), "_cum", "sum", fits=fits)
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"), F.count(F.lit(1)).alias("_n"))
    rows = join_same(rows, bounded(totals), by)
    diagonal = F.when(F.col("_n") > 1, (F.col("_i") - 1) / (F.col("_n") - 1)).otherwise(F.lit(0.0))
    flat = F.col("_total") == 0
    points = rows.select(
        *by, F.col("_i").alias("point"), F.when(flat, diagonal).otherwise(F.col("_i") / F.col("_n")).alias("x"),
        F.when(flat, diagonal).otherwise(F.try_divide(F.col("_cum"), F.col("_total"))).alias("y"))
    zero = F.lit(0.0)
    origin = totals.where("_total <> 0").select(*by, F.lit(0).cast("long").alias("point"), zero.alias("x"), zero.alias("y"))
    return points.unionByName(origin)


def higher_criticism(df: DataFrame, by: Sequence[str], p: str, tie: str = "set_id") -> DataFrame:
    """Largest standardised excess of small p over its first half, and its 1-based index."""
    by = list(by)
    df, fits = sized(df, by)
    rows = ranked(df, by, [F.col(p), F.col(tie)], "_i", fits)
    rows = join_same(rows, bounded(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))), by)
    rows = rows.where(F.col("_i") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 2)))
    q = F.col(p)
    score = F.when((q > 0) & (q < 1), F.sqrt("_n") * (F.col("_i") / F.col("_n") - q) / F.sqrt(q * (1 - q)))
    best = rows.withColumn("_hc", score).groupBy(*by).agg(F.max(F.struct(F.col("_hc"), (-F.col("_i")).alias("_i"))).alias("_b"))
    return best.select(*by, F.col("_b._hc").alias("hc"), F.when(F.col("_b._hc").isNull(), F.lit(1).cast("long")).otherwise(-F.col("_b._i")).alias("hc_index"))


def signal_concentration(results: DataFrame, by: Sequence[str], p: str = "p", adj: str = "adj_p", ks: Sequence[int] = (10, 20)) -> DataFrame:
    """One row per comparison: concentration, higher criticism and counts at fixed cut-offs."""
    by = list(by)
    results = written(results)
    rows = results.withColumn("_e", evidence(F.col(p)))
    out = rows.groupBy(*by).agg(
        F.count_if(F.col(p) < 0.001).alias("n_p001"), F.count_if(F.col(p) < 0.01).alias("n_p01"), F.count_if(F.col(p) < 0.05).alias("n_p05"),
        F.count_if(F.col(adj) < 0.1).alias("n_adj10"), F.sum("_e").alias("total_evidence"), F.max("_e").alias("max_evidence"))
    for part in [gini(rows, by, "_e"), *[top_k_share(rows, by, "_e", k) for k in ks], higher_criticism(results, by, p)]:
        out = join_same(out, part, by)
    return out


def single_versus_combined(summary: DataFrame, context: Sequence[str], value: str, conditions: Sequence[str]) -> DataFrame:
    """Value of the combined condition minus the mean of the two single ones, per context."""
    one, two, both = conditions
    wide = summary.groupBy(*context).pivot("condition", list(conditions)).agg(F.first(value))
    return wide.dropna(subset=list(conditions)).withColumn("difference", F.col(both) - (F.col(one) + F.col(two)) / 2)


def qq_points(df: DataFrame, by: Sequence[str], p: str, tie: str = "set_id") -> DataFrame:
    """Expected and observed -log10 p, paired by rank."""
    by = list(by)
    df, fits = sized(df, by)
    rows = ranked(df, by, [F.col(p), F.col(tie)], "rank", fits)
    rows = join_same(rows, bounded(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))), by)
    return rows.select(*by, "rank", (-F.log10(F.col("rank") / (F.col("_n") + 1))).alias("expected"), evidence(F.least(F.col(p), F.lit(1.0))).alias("observed"))


