"""Exchanges of the pairs of sets."""

from pyspark.sql import functions as F

from foldwise.operators import joins


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_members_are_dealt_by_feature_once(spark):
    """Pairs of sets: one exchange for both sides of the pairs, one to count them, none for the sizes of sets."""
    members = spark.range(400).select((F.col("id") % 40).alias("feature_id"), (F.col("id") * F.col("id") % 13).alias("set_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = joins.jaccard_matrix(members)
        got = {(r.set_a, r.set_b): r.jaccard for r in rows.collect()}
        exchanges = plan(rows).split("Initial Plan")[0].count("Exchange hashpartitioning")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert exchanges <= 3
    sets: dict[int, set[int]] = {}
    for r in members.collect():
        sets.setdefault(r.set_id, set()).add(r.feature_id)
    assert got == {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
