"""Joins: alignment, bag matching, lookups, set overlap and threshold grids.

Join strategy is left to the optimizer, which broadcasts by measured size.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldwise.operators.enrichment import P_SIG, significant_strict
from foldwise.operators.ordering import ranked
from foldwise.session import bounded, materialise, written


def align_features(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids present on both sides."""
    return a.select(key).distinct().join(b.select(key).distinct(), key)


def sample_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each sample id with 'common', 'only_a' or 'only_b'."""
    both = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    sides = both.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "common").when(F.col("_a") == 1, "only_a").otherwise("only_b")
    return sides.select(key, side.alias("side"))


def upstream_sets(features: DataFrame, edges: DataFrame, allowed: DataFrame, on: Sequence[str], feature: str = "feature_id") -> DataFrame:
    """Distinct (feature, set) pairs through the edge keys, restricted to known sets.

    The pairs may be many times the rows, so both sides are made distinct before they meet; only
    features with several keys can reach a set twice, and only their pairs are compared.
    """
    on = list(on)
    known = materialise(edges.join(allowed.select("set_id").distinct(), "set_id", "left_semi").select(*on, "set_id").distinct())
    keys = features.groupBy(feature).agg(F.collect_set(F.struct(*on)).alias("_keys"))
    one = keys.where(F.size("_keys") == 1).select(feature, F.inline("_keys")).join(known, on).select(feature, "set_id")
    more = keys.where(F.size("_keys") > 1).select(feature, F.inline("_keys")).join(known, on).select(feature, "set_id").distinct()
    return one.unionByName(more)


def match_rate(features: DataFrame, pairs: DataFrame, feature: str = "feature_id") -> DataFrame:
    matched = pairs.select(feature).distinct().withColumn("_hit", F.lit(1))
    return features.select(feature).distinct().join(matched, feature, "left").agg(
        F.count("_hit").alias("n_matched"), F.count(F.lit(1)).alias("n_features"), (F.count("_hit") / F.count(F.lit(1))).alias("rate"))


def condition_triplets(results: DataFrame, context: Sequence[str], conditions: Sequence[str], p_col: str = "adj_p", p_sig: float = P_SIG) -> DataFrame:
    """One row per (context, set) with the three conditions side by side.

    ``conditions`` is (single, other single, combined).  A context counts only if
    all three were tested; its sets are those of the first condition.
    """
    one, two, both = conditions
    fields = {"lff": "lff", "p": p_col, "dir": "direction", "n": "n_members", "median": "median_lfc"}
    picks = [F.max(F.when(F.col("condition") == c, F.col(col))).alias(f"{name}_{c}") for c in conditions for name, col in fields.items()]
    full = results.groupBy(*context).agg(F.count_distinct("condition").alias("_n")).where(F.col("_n") == len(conditions))
    rows = (
        results.where(F.col("condition").isin(*conditions)).groupBy(*context, "set_id")
        .agg(*picks, F.count_if(F.col("condition") == one).alias("_first")).where("_first > 0").drop("_first")
        .join(full.select(*context), list(context), "left_semi")
    )
    rows = rows.withColumn("lff_sum", F.col(f"lff_{one}") + F.col(f"lff_{two}"))
    rows = rows.withColumn("lff_residual", F.col(f"lff_{both}") - F.col("lff_sum"))
    return rows.withColumns({f"sig_{c}": significant_strict(F.col(f"p_{c}"), p_sig) for c in conditions})


def assemble_columns(results: DataFrame, index: str, label: Column, labels: Sequence[str], value: str) -> DataFrame:
    """A column per comparison, outer-joined on the index (done as one pivot)."""
    return results.withColumn("_label", label).groupBy(index).pivot("_label", list(labels)).agg(F.first(value))


def bag_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Equal keys of both sides paired first-in first-out: ``keys, occurrence, left, right``.

    A row without a partner has a null there, as has a row with a missing key, which matches nothing.
    Both sides are one table until they meet: ranked once by key and side, then grouped once by key
    and occurrence, so that a hot key spreads over tasks.
    """
    rest = lambda df: F.struct(*[F.col(c) for c in df.columns if c not in keys])
    sort = lambda df: F.struct(*[F.col(c) for c in order])
    empty = lambda df: F.lit(None).cast(df.select(rest(df).alias("s")).schema["s"].dataType)
    a = left.select(*keys, F.lit(0).alias("_side"), sort(left).alias("_order"), rest(left).alias("left"), empty(right).alias("right"))
    b = right.select(*keys, F.lit(1).alias("_side"), sort(right).alias("_order"), empty(left).alias("left"), rest(right).alias("right"))
    rows = ranked(a.unionByName(b), [*keys, "_side"], [F.col("_order")], "occurrence")
    alone = F.lit(False)
    for k in keys:
        alone = alone | F.col(k).isNull()
    rows = rows.withColumn("_side", F.when(alone, F.col("_side")))
    return rows.groupBy(*keys, "occurrence", "_side").agg(F.any_value("left", True).alias("left"), F.any_value("right", True).alias("right")).drop("_side")


def bag_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Paired rows, the right side's columns with ``right_``; the unmatched left rows; the unused right rows."""
    rows = written(bag_pairs(left, right, keys, order))
    on = [*keys, "occurrence"]
    l_columns, r_columns = ([c for c in df.columns if c not in keys] for df in (left, right))
    l_row, r_row = [F.col(f"left.{c}").alias(c) for c in l_columns], [F.col(f"right.{c}").alias(c) for c in r_columns]
    pairs = rows.where("left IS NOT NULL AND right IS NOT NULL").select(*on, *l_row, *[F.col(f"right.{c}").alias(f"right_{c}") for c in r_columns])
    return pairs, rows.where("right IS NULL").select(*on, *l_row), rows.where("left IS NULL").select(*on, *r_row)


def annotate(df: DataFrame, dim: DataFrame, key: str, defaults: Mapping[str, object]) -> DataFrame:
    """Left join a lookup; gaps take ``defaults``."""
    joined = df.join(dim.select(key, *defaults), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def unmapped_default(df: DataFrame, number: str, mapping: DataFrame, name: str) -> DataFrame:
    """Sample number to sample id, or 'unmapped_<number>'."""
    joined = df.join(mapping, number, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.concat(F.lit("unmapped_"), F.col(number).cast("string"))))


def merge_metadata(df: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    return df.join(meta, key)


# Sets of one feature that one task pairs with all others; a feature in more is spread over that many times the tasks.
SALT_SETS = 200


def set_overlaps(members: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Shared-member counts of set pairs (set_a < set_b) that share at least one member.

    Pairs without a common member are not produced: their overlap is 0.  Members are dealt by feature
    once.  A feature belonging to many sets is salted, so its pairs split over tasks; pair counts are
    combined map-side before they shuffle.
    """
    keys = ["feature_id"]
    rows = members.select("feature_id", "set_id").where("feature_id IS NOT NULL")
    if families is not None:
        rows, keys = written(rows.distinct().join(families, "set_id")), ["feature_id", "family"]
    hot = bounded(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_degree")).where(F.col("_degree") > SALT_SETS))
    any_hot = not hot.isEmpty()
    cold = rows.join(hot, keys, "left_anti") if any_hot else rows
    cold = cold.repartition(*keys) if families is not None else cold.repartition(*keys).distinct()
    pairs = cold.withColumnRenamed("set_id", "set_a").join(cold.withColumnRenamed("set_id", "set_b"), keys)
    if any_hot:
        rows = (rows if families is not None else rows.distinct()).join(hot, keys)
        salts = F.ceil(F.col("_degree") / SALT_SETS)
        left = rows.withColumn("_salt", F.pmod(F.xxhash64("set_id"), salts)).withColumnRenamed("set_id", "set_a").drop("_degree")
        right = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).withColumnRenamed("set_id", "set_b").drop("_degree")
        pairs = pairs.unionByName(left.join(right, [*keys, "_salt"]).drop("_salt"))
    pairs = pairs.where(F.col("set_a") < F.col("set_b"))
    return pairs.groupBy(*(["family"] if families is not None else []), "set_a", "set_b").agg(F.count(F.lit(1)).alias("shared"))


def _jaccard(overlaps: DataFrame, members: DataFrame) -> DataFrame:
    sizes = bounded(members.select("feature_id", "set_id").distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("_n")))
    rows = overlaps.join(sizes.toDF("set_a", "n_a"), "set_a").join(sizes.toDF("set_b", "n_b"), "set_b")
    rows = rows.withColumn("joined", F.col("n_a") + F.col("n_b") - F.col("shared"))
    return rows.withColumn("jaccard", F.col("shared") / F.col("joined"))


def family_pairs(members: DataFrame, families: DataFrame) -> DataFrame:
    """Intersection, union and Jaccard index of overlapping set pairs within a family."""
    return _jaccard(set_overlaps(members, families), members)


def jaccard_matrix(members: DataFrame) -> DataFrame:
    """Non-zero off-diagonal entries (upper triangle) of the Jaccard matrix of all sets."""
    return _jaccard(set_overlaps(members), members)


def comparison_grid(spark: SparkSession, **dims: Sequence) -> DataFrame:
    """All combinations of short configuration lists."""
    rows = list(itertools.product(*dims.values()))
    kinds = {str: "string", int: "int", float: "double"}
    schema = ", ".join(f"{name} {kinds[type(values[0])]}" for name, values in dims.items())
    return spark.createDataFrame(rows, schema)


def resolve_symbols(names: DataFrame, hits: DataFrame) -> DataFrame:
    """Best symbol of a name: exact symbol, then exact alias, then first hit, then itself.

    ``hits`` has (name, position, symbol, alias).  The best hit is an aggregate
    minimum, so a name with many hits is reduced before the shuffle.
    """
    lower = lambda c: F.lower(F.col(c))
    level = F.when(lower("symbol") == lower("name"), 0).when(lower("alias") == lower("name"), 1).otherwise(2)
    best = hits.groupBy("name").agg(F.min(F.struct(level.alias("level"), F.col("position"), F.col("symbol"))).alias("_best"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce(F.col("_best.symbol"), F.col("name")).alias("symbol"))


def expression_flags(genes: DataFrame, experiments: DataFrame, passing: Column, key: str) -> DataFrame:
    """Number of passing experiments per gene, and whether there is any."""
    counts = experiments.where(passing).groupBy(key).agg(F.count(F.lit(1)).alias("n_experiments"))
    joined = genes.select(key).distinct().join(counts, key, "left")
    joined = joined.withColumn("n_experiments", F.coalesce("n_experiments", F.lit(0).cast("long")))
    return joined.withColumn("expressed", F.col("n_experiments") > 0)


def restrict(df: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    return df.join(universe.select(key).distinct(), key, "left_semi")


# ---- set operations --------------------------------------------------------

def gained_lost(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """'gained' rows are in b only, 'lost' rows in a only."""
    gained = b.select(*keys).exceptAll(a.select(*keys)).withColumn("change", F.lit("gained"))
    return gained.unionByName(a.select(*keys).exceptAll(b.select(*keys)).withColumn("change", F.lit("lost")))


def intersect_sets(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def hit_in_all(hits: DataFrame, key: str, column: str, values: Sequence) -> DataFrame:
    """Keys seen with every one of ``values``."""
    seen = [F.max(F.when(F.col(column) == v, 1).otherwise(0)) for v in values]
    total = seen[0]
    for s in seen[1:]:
        total = total + s
    return hits.groupBy(key).agg(total.alias("_n")).where(F.col("_n") == len(values)).select(key)


def union_distinct(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """The row with the largest ``order`` per key (window top-1, cut down before the shuffle)."""
    first = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
