"""Fold changes, feature classes and set enrichment, for all comparisons in one plan.

A comparison is a value of the ``by`` columns (for example group, timepoint and
treatment).  Nothing loops over comparisons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.columns import TIER_BOUNDS, clean, evidence_tier, log2_fold_change
from foldwise.functions.special import hypergeometric_upper
from foldwise.operators.keys import join_same
from foldwise.operators.ordering import group_percentiles, ranked, running, sized
from foldwise.session import bounded, materialise, written

# The reported thresholds.
PERCENT = 5.0        # share of features called up, and share called down
LFF_MIN = 0.01       # smallest |log frequency factor| of a hit
P_SIG = 0.1          # largest adjusted p of a hit
P_DISPLAY = 0.5      # adjusted p below which a tail cell is shown
TAIL = 5.0           # percent in each tail of the frequency factors
SAME = 1e-9          # relative difference below which two results count as equal
MIN_P95 = 0.1        # smallest 95th percentile of |fold change| worth testing


def fold_changes(
    cells: DataFrame, keys: Sequence[str], condition: str, control: str, treatments: Sequence[str], value: str = "value", summed: bool = False
) -> DataFrame:
    """log2 fold change of every treatment against ``control`` (one shuffle, no self-join).

    With ``summed``, ``cells`` has the parts of a cell, which are added up in the same aggregation.
    """
    picked = [F.when(F.col(condition) == c, F.col(value)) for c in [control, *treatments]]
    per = [(clean(F.sum(v)) if summed else F.max(clean(v))).alias(f"_{i}") for i, v in enumerate(picked)]
    wide = cells.groupBy(*keys).agg(*per).where(F.col("_0").isNotNull())
    pairs = F.array(*[
        F.struct(F.lit(c).alias("condition"), F.col(f"_{i + 1}").alias("fg")) for i, c in enumerate(treatments)
    ])
    return (
        wide.withColumn("_pair", F.explode(pairs))
        .where(F.col("_pair.fg").isNotNull())
        .select(*keys, F.col("_pair.condition").alias(condition), log2_fold_change(F.col("_pair.fg"), F.col("_0")).alias("lfc"))
    )


def foreground_gate(lfc: DataFrame, by: Sequence[str], min_p95: float = MIN_P95) -> DataFrame:
    """Keep comparisons whose 95th percentile of |fold change| reaches ``min_p95``."""
    lfc = written(lfc)
    sizes = group_percentiles(lfc.withColumn("_abs", F.abs("lfc")), by, "_abs", {"p95": 0.95})
    return join_same(lfc, bounded(sizes.where(F.col("p95") >= min_p95).select(*by)), by, "left_semi")


def classify_sites(lfc: DataFrame, by: Sequence[str], pct: float = PERCENT, feature: str = "feature_id") -> DataFrame:
    """Top ``pct`` percent of each comparison is 'up', bottom ``pct`` 'down', the rest 'bg'.

    Adds ``n`` (features in the comparison) and ``k`` (features per side).  Ties
    in the fold change go by feature id, so one ascending rank serves both sides.
    """
    lfc, fits = sized(lfc, by)
    rows = ranked(lfc, by, [F.col("lfc"), F.col(feature)], "_rank", fits)
    rows = join_same(rows, bounded(lfc.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))), by)
    rows = rows.withColumn("k", F.floor(F.col("n") * F.lit(pct) / 100).cast("long"))
    side = F.when(F.col("_rank") <= F.col("k"), "down").when(F.col("_rank") > F.col("n") - F.col("k"), "up").otherwise("bg")
    return rows.withColumn("class", side).drop("_rank")


def classify_at(lfc: DataFrame, by: Sequence[str], pcts: Sequence[float], feature: str = "feature_id", nested: bool = False) -> DataFrame:
    """Classes at several shares from one ranking; ``pct`` becomes a further comparison key.

    ``nested`` keeps one row a feature, with the classes in the order of ``pcts`` as ``classes``.
    """
    lfc, fits = sized(lfc, by)
    rows = ranked(lfc, by, [F.col("lfc"), F.col(feature)], "_rank", fits)
    rows = join_same(rows, bounded(lfc.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))), by)

    def side(pct: Column) -> Column:
        k = F.floor(F.col("n") * pct / 100)
        return F.when(F.col("_rank") <= k, "down").when(F.col("_rank") > F.col("n") - k, "up").otherwise("bg")

    if nested:
        return rows.withColumn("classes", F.array(*[side(F.lit(float(p))) for p in pcts])).drop("_rank")
    rows = rows.withColumn("pct", F.explode(F.array(*[F.lit(float(p)) for p in pcts])))
    return rows.withColumn("class", side(F.col("pct"))).drop("_rank")


def classify_by_threshold(lfc: DataFrame, by: Sequence[str], threshold: float) -> DataFrame:
    """Sides by a fixed fold change instead of a share; side sizes then differ."""
    side = F.when(F.col("lfc") >= threshold, "up").when(F.col("lfc") <= -threshold, "down").otherwise("bg")
    return lfc.withColumn("class", side)


def members_from_scores(
    scores: DataFrame, rank_k: int | None = None, min_score: float | None = None,
    feature: str = "feature_id", set_id: str = "set_id", score: str = "score",
) -> DataFrame:
    """Members of each set: a set belongs to a feature's best ``rank_k``, or scores ``min_score``.

    The rank filter is a window top-k, which Spark cuts down before the shuffle.
    """
    if rank_k is None:
        return scores.where(F.col(score) >= min_score).select(feature, set_id)
    best = Window.partitionBy(feature).orderBy(F.col(score).desc(), F.col(set_id))
    return scores.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= rank_k).select(feature, set_id)


def contingency(classes: DataFrame, members: DataFrame, by: Sequence[str], pcts: Sequence[float] = ()) -> DataFrame:
    """Hits of every set on each side: one row per (comparison, set).

    Works for percent classes (``k`` on both sides) and threshold classes.  With ``pcts``, for nested
    classes at these shares: a member is joined and shuffled once and becomes a row a share when counted.
    Rows carry a number instead of their comparison while they are joined and shuffled.
    """
    plain = [key for key in by if key != "pct"] if pcts else list(by)
    shares = range(len(pcts) or 1)
    side = [F.col("classes")[k] if pcts else F.col("class") for k in shares]
    classes = written(classes)
    sizes = classes.groupBy(*plain).agg(*_side_counts(side, {"up": "n_up", "down": "n_down", "bg": "n_bg"}))
    sizes = bounded(sizes.withColumn("_number", F.monotonically_increasing_id()))
    numbered = [F.when(s == "up", 0).when(s == "down", 1).when(s == "bg", 2).cast("byte").alias(f"_side_{k}") for k, s in enumerate(side)]
    rows = join_same(classes.select("feature_id", *plain, *numbered), sizes.select(*plain, "_number"), plain).drop(*plain)
    counted = _side_counts([F.col(f"_side_{k}") for k in shares], {0: "a_up", 1: "a_down", 2: "c"})
    counts = rows.join(members, "feature_id").groupBy("_number", "set_id").agg(*counted).join(sizes, "_number")
    names = ["a_up", "a_down", "c", "n_up", "n_down", "n_bg"]
    table = [F.struct(*([F.lit(float(pcts[k])).alias("pct")] if pcts else []), *[F.col(f"_{n}_{k}").alias(n) for n in names]) for k in shares]
    return counts.select(*plain, "set_id", F.inline(F.array(*table))).select(*by, "set_id", *names)


def _side_counts(sides: Sequence[Column], names: dict) -> list[Column]:
    """Rows of each side, under ``names``, for each share."""
    return [F.count_if(side == value).alias(f"_{name}_{k}") for k, side in enumerate(sides) for value, name in names.items()]


def frequency_factor(a: Column, b: Column, c: Column, d: Column) -> Column:
    """log2 of the hit share on a side over the share in the background (+0.5 when a cell is 0)."""
    add = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), F.lit(0.5)).otherwise(F.lit(0.0))
    side = (a + add) / (a + b + 2 * add)
    background = (c + add) / (c + d + 2 * add)
    return F.log2(side / background)


def score_sets(counts: DataFrame) -> DataFrame:
    """Frequency factor, one-sided exact p and the better side of each contingency row.

    The counts are small numbers, so most sets share their 2x2 tables with others: each distinct table
    is tested once.  Few bytes but much arithmetic: the tables are spread over a fixed number of
    tasks, which adaptive execution would otherwise merge into one.
    """
    counts = written(counts)
    table = ["_a", "_n", "_c", "_n_bg"]
    sides = [counts.select(*[F.col(c).alias(t) for c, t in zip((f"a_{s}", f"n_{s}", "c", "n_bg"), table, strict=True)]) for s in ("up", "down")]
    tables = sides[0].unionByName(sides[1]).distinct().repartition(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tested = bounded(tables.withColumn("_p", hypergeometric_upper("_a", "_n - _a", "_c", "_n_bg - _c")))
    for s in ("up", "down"):
        named = dict(zip(table, (f"a_{s}", f"n_{s}", "c", "n_bg"), strict=True))
        counts = join_same(counts, tested.withColumnsRenamed(named | {"_p": f"p_{s}"}), list(named.values()))
    a_up, a_down, c = F.col("a_up"), F.col("a_down"), F.col("c")
    d = F.col("n_bg") - c
    up = (a_up, F.col("n_up") - a_up, c, d)
    down = (a_down, F.col("n_down") - a_down, c, d)
    best_up = F.col("p_up") <= F.col("p_down") * (1 + SAME)  # equal up to rounding: up
    return (
        counts.withColumn("direction", F.when(best_up, "+").otherwise("-"))
        .withColumn("lff", F.when(best_up, frequency_factor(*up)).otherwise(-frequency_factor(*down)))
        .withColumn("p", F.least("p_up", "p_down"))
    )


def bh_adjust(
    df: DataFrame, by: Sequence[str], p: str, name: str = "adj_p", m_eff: float | None = None, tie: str = "set_id"
) -> DataFrame:
    """Step-up correction: running minimum from the largest p of p * m / rank, kept in [0, 1].

    ``m_eff`` replaces the number of tests; without it this is Benjamini-Hochberg.
    """
    by = list(by)
    df, fits = sized(df, by)
    rows = ranked(df, by, [F.col(p), F.col(tie)], "_rank", fits)
    if m_eff is not None:
        rows = rows.withColumn("_m", F.lit(float(m_eff)))
    else:
        rows = join_same(rows, bounded(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))), by)
    rows = running(rows, by, "_rank", F.col(p) * F.col("_m") / F.col("_rank"), "_adj", "min", reverse=True, fits=fits)
    return rows.withColumn(name, F.greatest(F.least("_adj", F.lit(1.0)), F.lit(0.0))).drop("_rank", "_m", "_adj")


def enrich(classes: DataFrame, members: DataFrame, by: Sequence[str], pcts: Sequence[float] = ()) -> DataFrame:
    """Set enrichment per comparison with BH-adjusted p; ``pcts`` are the shares of nested classes."""
    return bh_adjust(materialise(score_sets(contingency(classes, members, by, pcts))), by, "p")


def enriched_members(classes: DataFrame, members: DataFrame, results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Members of a set that lie on the side its enrichment chose."""
    side = F.when(F.col("direction") == "-", "down").otherwise("up")
    wanted = results.select(*by, "set_id", side.alias("class"))
    hits = classes.where(F.col("class") != "bg").join(members, "feature_id")
    return join_same(hits, wanted, [*by, "set_id", "class"]).select(*by, "set_id", "feature_id", "class", "lfc")


def substrate_stats(
    classes: DataFrame, members: DataFrame, results: DataFrame, by: Sequence[str],
    p_col: str = "adj_p", p_sig: float = P_SIG, lff_min: float = LFF_MIN,
) -> DataFrame:
    """Count, median, upper quartile and maximum of |fold change| over each hit's enriched members."""
    hits = enriched_members(classes, members, results.where(significant(F.col(p_col), F.col("lff"), p_sig, lff_min)), by)
    hits = hits.withColumn("abs_lfc", F.abs("lfc"))
    return group_percentiles(
        hits, [*by, "set_id"], "abs_lfc", {"median_lfc": 0.5, "q75_lfc": 0.75},
        [F.count(F.lit(1)).alias("n_members"), F.max("abs_lfc").alias("max_lfc")],
    )


def significant(p: Column, lff: Column, p_sig: float = P_SIG, lff_min: float = LFF_MIN) -> Column:
    """|lff| >= lff_min and p <= p_sig."""
    return (F.abs(lff) >= lff_min) & (p <= p_sig)


def significant_strict(p: Column, p_sig: float = P_SIG) -> Column:
    """p < p_sig, without an effect-size test (additivity analyses)."""
    return p < p_sig


def tail_bounds(results: DataFrame, by: Sequence[str], tail: float = TAIL) -> DataFrame:
    """Bounds per comparison, ready to join: comparisons are few beside the rows they label."""
    return bounded(group_percentiles(results, by, "lff", {"lff_low": tail / 100, "lff_high": 1 - tail / 100}))


def in_tail() -> Column:
    """At or beyond a bound; interpolation may move a bound off a tied value by a rounding error."""
    return (F.col("lff") >= F.col("lff_high") - SAME) | (F.col("lff") <= F.col("lff_low") + SAME)


def significance_tier(
    results: DataFrame, by: Sequence[str], p_col: str = "adj_p", p_sig: float = P_SIG, lff_min: float = LFF_MIN,
    p_display: float = P_DISPLAY, tail: float = TAIL,
) -> DataFrame:
    """Label rows significant / display / non_significant; adds the comparison's tail bounds."""
    results = written(results)
    rows = join_same(results, tail_bounds(results, by, tail), by)
    tier = (
        F.when(significant(F.col(p_col), F.col("lff"), p_sig, lff_min), "significant")
        .when(in_tail() & (F.col(p_col) < p_display), "display")
        .otherwise("non_significant")
    )
    return rows.withColumn("tier", tier)


def attach_evidence(results: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join member statistics and label their strength."""
    joined = join_same(results, stats, [*by, "set_id"], "left")
    return joined.withColumn("evidence", evidence_tier(F.col("median_lfc"), TIER_BOUNDS))
