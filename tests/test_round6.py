"""Steps of the enrichment table whose exchanges and passes do not grow faster than their rows."""

import math

from pyspark.sql import functions as F

from foldwise.operators import enrichment


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summed_fold_changes_take_one_aggregation(spark):
    lines = spark.createDataFrame([
        (1, "x", "C", 1.0), (1, "x", "C", 2.0), (1, "x", "T", 7.0), (1, None, "C", 0.0), (1, None, "T", None), (1, None, "T", 3.0),
        (2, "x", "C", None), (2, "x", "T", 5.0), (3, "x", "C", math.nan), (3, "x", "T", 5.0), (None, "x", "C", 3.0), (None, "x", None, 9.0), (None, "x", "T", 1.0),
    ], "feature_id long, grp string, condition string, value double")
    keys = ["feature_id", "grp"]
    got = enrichment.fold_changes(lines.repartition(*keys), keys, "condition", "C", ["T"], summed=True)
    assert plan(got).count("Exchange") == 1 and plan(got).count("HashAggregate") == 2
    cells = lines.groupBy(*keys, "condition").agg(F.sum("value").alias("value"))
    want = enrichment.fold_changes(cells, keys, "condition", "C", ["T"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {(r.feature_id, r.grp): r.lfc for r in got.collect()} == {(1, "x"): 1.0, (1, None): 2.0, (None, "x"): -1.0}


def test_members_are_counted_by_number(spark):
    """Rows that are joined and shuffled hold no text; sets and comparisons without a name count like others."""
    classes = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, "x").alias("grp"), (F.col("id") % 100).alias("feature_id"),
        F.element_at(F.array(F.lit("up"), F.lit("down"), F.lit("bg")), (F.col("id") % 7 % 3 + 1).cast("int")).alias("class"))
    members = spark.range(250).select((F.col("id") % 110).alias("feature_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("set_id"))
    counts = enrichment.contingency(classes, members, ["grp"])
    shuffled = [line for line in plan(counts).splitlines() if "Exchange hashpartitioning" in line]
    assert shuffled and not any("grp" in line for line in shuffled)
    held, pairs, want = classes.collect(), members.collect(), []
    for grp in ("x", None):
        rows = [r for r in held if r.grp == grp]
        for name in {m.set_id for m in pairs}:
            hits = [r["class"] for r in rows for m in pairs if m.set_id == name and m.feature_id == r.feature_id]
            sides = [r["class"] for r in rows]
            want.append((grp, name, *[hits.count(c) for c in ("up", "down", "bg")], *[sides.count(c) for c in ("up", "down", "bg")]))
    assert sorted(map(str, map(tuple, counts.collect()))) == sorted(map(str, want))


def test_group_sizes_need_no_window(spark):
    rows = spark.range(200).select(F.when(F.col("id") % 4 > 0, "x").alias("grp"), F.col("id").alias("feature_id"), (F.col("id") * 37 % 101).cast("double").alias("lfc"))
    classes = enrichment.classify_sites(rows, ["grp"], 10.0)
    adjusted = enrichment.bh_adjust(rows.select("grp", F.col("feature_id").alias("set_id"), ((F.col("lfc") + 1) / 102).alias("p")), ["grp"], "p")
    assert "count(1) windowspecdefinition" not in plan(classes) and "count(1) windowspecdefinition" not in plan(adjusted)
    assert {(r.grp, r.n, r.k) for r in classes.collect()} == {("x", 150, 15), (None, 50, 5)}
    assert adjusted.count() == 200
