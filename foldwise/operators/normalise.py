"""Normalisation, pooling, profiles and imputation of measurement tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.operators.ordering import group_percentiles, whole_percentiles
from foldwise.session import bounded, written


def pooled_sums(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.sum(value).alias(value))


def baseline_profiles(m: DataFrame, pool: Mapping[str, str], summed: str = "Other") -> DataFrame:
    """Mean over samples per (feature, group); pooled labels average over their columns,
    except ``summed``, whose sub-types are averaged first and then added."""
    label = F.create_map(*[F.lit(x) for pair in pool.items() for x in pair])[F.col("grp")]
    per_type = m.groupBy("feature_id", "grp").agg(F.sum("value").alias("_s"), F.count("value").alias("_n")).withColumn("pooled", label)
    mean = F.try_divide(F.sum("_s"), F.sum("_n"))
    added = F.sum(F.try_divide(F.col("_s"), F.col("_n")))
    return per_type.where(F.col("pooled").isNotNull()).groupBy("feature_id", F.col("pooled").alias("grp")).agg(
        F.when(F.first("pooled") == summed, added).otherwise(mean).alias("value"))


def mean_by_key(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Mean over rows sharing a key; missing values do not count."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def size_factors(m: DataFrame) -> DataFrame:
    """Median-of-ratios factor per sample.

    A feature's reference is the geometric mean of its positive values; ratios
    include zeros; a factor of 0 becomes 1.
    """
    reference = m.groupBy("feature_id").agg(F.exp(F.avg(F.ln(F.nullif(F.col("value"), F.lit(0.0))))).alias("_ref"))
    ratios = m.where(F.col("value").isNotNull()).join(reference.where("_ref > 0"), "feature_id").withColumn("_ratio", F.col("value") / F.col("_ref"))
    factors = group_percentiles(ratios, ["sample_id"], "_ratio", {"factor": 0.5})
    return factors.withColumn("factor", F.when(F.col("factor") == 0, 1.0).otherwise(F.col("factor")))


def median_of_ratios(m: DataFrame) -> DataFrame:
    """Values divided by their sample's size factor."""
    return m.join(bounded(size_factors(m)), "sample_id").withColumn("value", F.col("value") / F.col("factor"))


def cpm(expr: DataFrame) -> DataFrame:
    """Counts per million within (group, sample); a total of 0 counts as 1."""
    totals = expr.groupBy("grp", "sample_id").agg(F.sum("value").alias("_total"))
    total = F.when(F.col("_total") == 0, 1.0).otherwise(F.col("_total"))
    return expr.join(bounded(totals), ["grp", "sample_id"]).withColumn("value", F.col("value") / total * 1e6).drop("_total")


def zscore(expr: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Centre and scale within ``by`` (sample standard deviation; 0 counts as 1)."""
    stats = expr.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_sd"))
    scale = F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd"))
    return expr.join(stats, list(by)).withColumn(value, (F.col(value) - F.col("_mean")) / scale).drop("_mean", "_sd")


def intensity_strata(df: DataFrame, value: str, q: int = 4) -> DataFrame:
    """Quantile bins of ``value``, closed on the left, numbered from 0.

    The inner edges are ``q - 1`` numbers, found without sorting the column.  A value
    equal to an edge up to rounding counts as reaching it.
    """
    df = written(df)
    edges = whole_percentiles(df, value, {str(k): k / q for k in range(1, q)})
    reached = [F.when(F.col(value) >= F.lit(e).cast("double") - 1e-9, 1).otherwise(0) for e in edges.values()]
    return df.withColumn("stratum", sum(reached[1:], reached[0]).cast("int"))


def condition_variation(expr: DataFrame, control: str) -> DataFrame:
    """Mean over genes of |mean under a condition - mean under control|, per (group, condition)."""
    means = expr.groupBy("grp", "gene", "condition").agg(F.avg("value").alias("_m"))
    base = means.where(F.col("condition") == control).select("grp", "gene", F.col("_m").alias("_c"))
    others = means.where(F.col("condition") != control).join(base, ["grp", "gene"])
    return others.groupBy("grp", "condition").agg(F.avg(F.abs(F.col("_m") - F.col("_c"))).alias("score"))


def _signature(column: str) -> Column:
    """Hash of a group's values as a multiset: their number and 128 bits of sums of their hashes, in any order.

    Sums, not exclusive ors, so that a value that comes twice counts twice; of 32 bits each, so that none overflows.
    """
    hashes = [F.xxhash64(F.col(column), F.lit(seed)) for seed in (1, 2)]
    halves = [h for x in hashes for h in (x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))]
    return F.xxhash64(F.count(column), *[F.sum(F.when(F.col(column).isNotNull(), h)) for h in halves])


def covariate_by_genes(edges: DataFrame, expr: DataFrame, opposing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mean expression of each distinct upstream gene list minus the mean of the opposing genes.

    ``edges`` is (feature_id, gene), ``opposing`` (gene).  Features that share their
    upstream genes share one mean, which is worked out once.  Gives (feature_id, genes)
    and (genes, grp, sample_id, r), where ``genes`` numbers a list by its hash. A feature's
    edges are folded to sums before they move; only distinct lists are gathered.
    """
    lists = written(edges.groupBy("feature_id").agg(_signature("gene").alias("genes")))
    against = expr.join(opposing.select("gene").distinct(), "gene", "left_semi").groupBy("grp", "sample_id").agg(F.avg("value").alias("_against"))
    # One feature stands for all that share its list; only its edges are looked up again.
    first = bounded(lists.groupBy("genes").agg(F.min("feature_id").alias("_first")))
    stands = F.col("feature_id").eqNullSafe(F.col("_first"))
    # A list's genes in their order, so that its mean adds them in one order.
    distinct = edges.where(F.col("gene").isNotNull()).join(first, stands).groupBy("genes").agg(F.sort_array(F.collect_list("gene")).alias("_l"))
    members = distinct.select("genes", F.explode("_l").alias("gene"))
    upstream = members.join(expr, "gene").groupBy("genes", "grp", "sample_id").agg(F.avg("value").alias("_for"))
    values = upstream.join(bounded(against), ["grp", "sample_id"], "left").select(
        "genes", "grp", "sample_id", (F.col("_for") - F.coalesce("_against", F.lit(0.0))).alias("r"))
    return lists.select("feature_id", "genes"), values


def expression_covariate(edges: DataFrame, expr: DataFrame, opposing: DataFrame) -> DataFrame:
    """The covariate as one row per (feature, group, sample).

    Features without an upstream gene have no rows: their covariate is 0.
    """
    features, values = covariate_by_genes(edges, expr, opposing)
    return features.join(bounded(values), "genes").select("feature_id", "grp", "sample_id", "r")


def impute_feature_mean(wide_rows: DataFrame) -> DataFrame:
    """Fill missing values with the feature's mean (0 if it has none); keeps a mask."""
    means = wide_rows.groupBy("feature_id").agg(F.avg("value").alias("_mean"))
    joined = wide_rows.join(means, "feature_id")
    return joined.withColumn("missing", F.col("value").isNull()).withColumn("value", F.coalesce("value", "_mean", F.lit(0.0))).drop("_mean")


def export_status(df: DataFrame, value: str = "value") -> DataFrame:
    """Row, sample, group and missing counts, and the value range."""
    return df.agg(F.count_distinct("feature_id").alias("n_rows"), F.count_distinct("sample_id").alias("n_samples"), F.count_distinct("grp").alias("n_groups"),
                  F.count_if(F.col(value).isNull()).alias("n_missing"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))


def summarise(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Range, zero, missing and non-zero counts of a column."""
    present = F.col(value).isNotNull()
    return df.groupBy(*by).agg(
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(value) == 0).alias("n_zero"), F.count_if(~present).alias("n_missing"),
        (F.count_if(present & (F.col(value) != 0)) / F.count(F.lit(1))).alias("nonzero_share"))


def spread_summary(df: DataFrame, by: Sequence[str], value: str, tiny: float = 1e-6) -> DataFrame:
    """Median, quartiles, range and share above ``tiny`` in size (fitted parameters)."""
    return group_percentiles(df, by, value, {"median": 0.5, "q25": 0.25, "q75": 0.75}, [
        F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.count(value).alias("n"), F.count_if(F.abs(F.col(value)) > tiny).alias("n_nonzero")])


def safe_ratio_lfc(value: Column, control: Column, floor: float = 1e-10) -> Column:
    return F.log2(F.greatest(value, F.lit(floor)) / F.greatest(control, F.lit(floor)))
