"""Ranking helpers: both ways give the same rows, whatever the keys and values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import enrichment as en
from foldwise.operators import ordering as od
from foldwise.operators import stats as st
from foldwise.operators import summaries as su


def frame(spark):
    """Null keys, a group without values, and one value on nine of ten rows of a group."""
    rng = np.random.default_rng(5)
    rows = [(None, "x", k, float(rng.integers(0, 5))) for k in range(13)]
    rows += [("a", None, 100 + k, None) for k in range(9)]
    rows += [("b", "x", 200 + k, 1.5 if k % 10 else float(k)) for k in range(60)]
    rows += [("c", "y", 300 + k, float(rng.random())) for k in range(3)] + [("d", "y", 400, None)]
    return spark.createDataFrame(rows, "g string, part string, set_id int, v double").repartition(5)


BY = ["g", "part"]


def canonical(df):
    return sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("make", [
    lambda df: od.ranked(df, BY, [F.col("v"), F.col("set_id")]),
    lambda df: od.ranked(df, [], [F.col("v"), F.col("set_id")]),
    lambda df: od.running(od.ranked(df, BY, [F.col("set_id")], "r"), BY, "r", F.col("v"), "total"),
    lambda df: od.running(od.ranked(df, BY, [F.col("set_id")], "r"), BY, "r", F.col("v"), "least", "min", reverse=True),
    lambda df: od.group_percentiles(df, BY, "v", {"q1": 0.25, "q2": 0.5, "q9": 0.93}, [F.count("v").alias("n")]),
    lambda df: od.group_percentiles(df, BY, "v", {"q2": 0.5}),
    lambda df: od.average_ranks(df.where("v IS NOT NULL"), BY, "v", "rank"),
    lambda df: en.bh_adjust(df.where("v IS NOT NULL").withColumn("p", F.col("v") / 60), BY, "p"),
    lambda df: en.classify_sites(df.where("v IS NOT NULL").withColumnRenamed("v", "lfc"), BY, 20.0, "set_id"),
    lambda df: su.higher_criticism(df.where("v IS NOT NULL").withColumn("p", F.col("v") / 60), BY, "p"),
    lambda df: su.lorenz(df.where("v IS NOT NULL"), BY, "v"),
    lambda df: st.kruskal(df.withColumn("k", F.col("set_id") % 4), BY, "k", "v"),
    lambda df: st.mean_tests(df.withColumn("v", F.col("v") - 1.0), BY, "v"),
    lambda df: st.correlations(df.withColumn("w", F.col("set_id") % 7), BY, "v", "w"),
])
def test_both_ways_agree(spark, make):
    df = frame(spark)
    small = canonical(make(df))
    spark.conf.set(od.GROUP_ROWS, "7")
    try:
        large = canonical(make(df))
    finally:
        spark.conf.unset(od.GROUP_ROWS)
    assert small == large and small


def test_null_keys_and_empty_groups_stay(spark):
    df = frame(spark)
    spark.conf.set(od.GROUP_ROWS, "7")
    try:
        got = {(r.g, r.part): r.q for r in od.group_percentiles(df, BY, "v", {"q": 0.5}).collect()}
    finally:
        spark.conf.unset(od.GROUP_ROWS)
    assert set(got) == {(None, "x"), ("a", None), ("b", "x"), ("c", "y"), ("d", "y")} and got["a", None] is None and got["b", "x"] == 1.5


@pytest.mark.parametrize("few", [50_000, 40, 3])
def test_whole_percentiles(spark, monkeypatch, few):
    monkeypatch.setattr(od, "_BRACKET_VALUES", few)
    rng = np.random.default_rng(7)
    for values in (rng.normal(size=2001), np.concatenate((np.zeros(900), rng.random(101))), np.array([3.0]), np.repeat([1.0, 2.0], 500)):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
        got = od.whole_percentiles(df, "v", {"a": 0.01, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0})
        want = np.quantile(values, [0.01, 0.5, 0.99, 0.0, 1.0])
        assert list(got.values()) == pytest.approx(want.tolist(), abs=1e-12)
    assert od.whole_percentiles(df.where("false"), "v", {"a": 0.5}) == {"a": None}


def test_the_input_runs_once(spark):
    """The size check reads the written input, not its plan again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def count(x):
        seen.add(1)
        return x

    df = spark.range(20).select((F.col("id") % 3).alias("g"), count("id").alias("set_id"))
    od.ranked(df, ["g"], [F.col("set_id")]).collect()
    assert seen.value == 20
