"""Steps whose cost at size goes by distinct values or by rows once, not by every row again."""

import math

import pytest
from pyspark.sql import functions as F

from foldwise import session
from foldwise.operators import corrections, enrichment, ordering, stats
from foldwise.plans import inputs


@pytest.fixture()
def writes(monkeypatch):
    """Row counts of all tables that operators write."""
    kept, original = [], session.materialise

    def recorded(df, *args, **kwargs):
        out = original(df, *args, **kwargs)
        kept.append(out.count())
        return out

    for module in (session, ordering, stats, enrichment, corrections):
        monkeypatch.setattr(module, "materialise", recorded, raising=False)
    return kept


def plain_h(rows):
    """Kruskal-Wallis H of (group, value) pairs, corrected for ties."""
    values, n = [v for _, v in rows], len(rows)
    rank = {v: sum(w < v for w in values) + (values.count(v) + 1) / 2 for v in set(values)}
    q = sum(sum(rank[v] for g, v in rows if g == k) ** 2 / sum(g == k for g, _ in rows) for k in {g for g, _ in rows})
    return (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - sum(values.count(v) ** 3 - values.count(v) for v in rank) / (n ** 3 - n))


@pytest.mark.parametrize("bound", [None, 2])
def test_kruskal_folds_equal_values(spark, writes, bound):
    if bound:
        spark.conf.set(ordering.GROUP_ROWS, str(bound))
    try:
        rows = spark.range(3000).select(
            F.when(F.col("id") % 5 > 0, "x").alias("b"), (F.col("id") % 3).alias("g"), (F.col("id") * F.col("id") % 7).cast("double").alias("v"))
        got = {r.b: r for r in stats.kruskal(rows, ["b"], "g", "v").collect()}
    finally:
        spark.conf.unset(ordering.GROUP_ROWS)
    assert max(writes) <= 2 * 3 * 7
    held = rows.collect()
    for b in ("x", None):
        assert got[b].h == pytest.approx(plain_h([(r.g, r.v) for r in held if r.b == b])) and got[b].n_groups == 3


def test_equal_tables_are_tested_once(spark, writes):
    counts = spark.range(200).select(
        F.col("id").alias("set_id"), F.lit(10).alias("n_up"), F.lit(10).alias("n_down"), F.lit(80).alias("n_bg"),
        (F.col("id") % 2 + 1).alias("a_up"), F.lit(1).alias("a_down"), F.lit(5).alias("c"))
    rows = enrichment.score_sets(counts).collect()
    assert writes == [200, 2] and len(rows) == 200
    alone = 1 - math.comb(84, 10) / math.comb(90, 10)
    assert all(r.p_down == pytest.approx(alone) and (r.p_up == r.p_down if r.a_up == 1 else r.p_up < r.p_down) for r in rows)


def test_nested_classes_count_like_exploded_ones(spark):
    lfc = spark.range(400).select(
        F.when(F.col("id") % 4 > 0, "x").alias("grp"), F.col("id").alias("feature_id"), (F.col("id") * 37 % 101).cast("double").alias("lfc"))
    members = spark.range(400).select(F.col("id").alias("feature_id"), F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("set_id"))
    pcts, by = [2.5, 10.0, 60.0], ["pct", "grp"]
    long = enrichment.contingency(enrichment.classify_at(lfc, ["grp"], pcts), members, by)
    nested = enrichment.contingency(enrichment.classify_at(lfc, ["grp"], pcts, nested=True), members, by, pcts)
    assert nested.columns == long.columns
    assert sorted(map(str, nested.collect())) == sorted(map(str, long.collect()))


def test_members_take_one_exchange(spark, tmp_path):
    lines = spark.range(300).select(
        (F.col("id") % 10).alias("l_partkey"), (F.col("id") % 8).alias("l_suppkey"), (F.col("id") / 100).alias("l_extendedprice"))
    lines.write.parquet(str(tmp_path / "lineitem.parquet"))
    df = enrichment.members_from_scores(inputs.scores(spark, str(tmp_path)), rank_k=3)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert df.count() == 30
