"""Permutations of all sets of a comparison together, and sequential draws inside a row."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import corrections as co
from foldwise.operators import diagnostics as di
from foldwise.operators import enrichment as en
from foldwise.operators import joins as jo
from foldwise.operators import models as mo


@pytest.fixture(scope="module")
def comparisons(spark):
    """Two comparisons of different size, one of them without a key; members that repeat, sets without a key."""
    rng = np.random.default_rng(5)
    cells = [(c, f, float(v)) for c, n in (("x", 137), (None, 60)) for f, v in enumerate(rng.normal(size=n))]
    lfc = spark.createDataFrame(cells, "c string, feature_id long, lfc double")
    pairs = [(int(f), s) for s, size in ((1, 3), (2, 40), (3, 90), (None, 25)) for f in rng.choice(137, size, replace=False)]
    members = spark.createDataFrame(pairs + pairs[:4], "feature_id long, set_id int")
    return en.classify_sites(lfc, ["c"], 10.0), members


def drawn(classes, members, n_perm, seed):
    """Hits by sending places to features, draw by draw."""
    number = {}
    for c, f in sorted(((r.c, r.feature_id) for r in classes.collect()), key=lambda x: (x[0] is None, x)):
        number.setdefault(c, []).append(f)
    sets = {}
    for r in members.collect():
        sets.setdefault(r.feature_id, []).append(r.set_id)
    counts = {}
    for r in co.permuted_sides(classes, ["c"], n_perm, seed).collect():
        for s in sets.get(number[r.c][r.number], []):
            pair = counts.setdefault((r.c, s), {}).setdefault(r.perm, [0, 0])
            pair[r.down] += 1
    out = {}
    for key, perms in counts.items():
        for up, down in perms.values():
            at = out.setdefault(key, {})
            at[up, down] = at.get((up, down), 0) + 1
    return out


@pytest.mark.parametrize("rows, cells", [(20_000, 4_000_000), (3, 80)])
def test_places_by_the_inverse_are_the_draws(spark, comparisons, monkeypatch, rows, cells):
    monkeypatch.setattr(co, "HIT_ROWS", rows)
    monkeypatch.setattr(co, "HIT_CELLS", cells)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if rows == 3 else "10000")
    try:
        found = co.shuffled_hits(*comparisons, ["c"], 40, 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 8
    got = {(r.c, r.set_id): {(o._up, o._down): o._times for o in r._outcomes} for r in found}
    assert got == drawn(*comparisons, 40, 9)


def test_sets_of_a_comparison_share_their_permutations(spark):
    """Two sets with the same members are beaten by the same permutations; draws set by set are not."""
    rng = np.random.default_rng(1)
    lfc = spark.createDataFrame([("x", f, float(v)) for f, v in enumerate(rng.normal(size=200))], "grp string, feature_id long, lfc double")
    classes = en.classify_sites(lfc, ["grp"], 10.0)
    some = [int(f) for f in rng.choice(200, 30, replace=False)]
    members = spark.createDataFrame([(f, s) for s in (1, 2, 3) for f in some], "feature_id long, set_id int")
    results = en.enrich(classes, members, ["grp"])
    p = [r.perm_p for r in co.shuffled_pvalues(classes, members, results, ["grp"], 400).collect()]
    assert len(p) == 3 and len(set(p)) == 1 and p[0] < 1
    assert co.shuffled_pvalues(classes.where("false"), members, results.where("false"), ["grp"], 10).count() == 0


def test_sequential_draws_move_no_rows_per_draw(spark):
    """One exchange of the sets themselves, none of draws."""
    rows = [("x", s, 2, 0, 4, 10, 10, 80, 0.1) for s in range(5)]
    df = spark.createDataFrame(rows, "grp string, set_id int, a_up long, a_down long, c long, n_up long, n_down long, n_bg long, p double")
    before = co.materialise
    plans = []
    co.materialise = lambda d, *a: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or before(d, *a)
    try:
        got = co.permutation_pvalues(df, ["grp"], 101, stop=3).collect()
    finally:
        co.materialise = before
    drawing = [p for p in plans if "md5" in p]
    assert len(drawing) == 1 and "Generate explode" not in drawing[0] and "Aggregate" not in drawing[0]
    assert all(3 <= r.n_drawn <= 101 for r in got)


def test_effects_are_not_broadcast(spark):
    """One parameter row is twelve effects: its size tells nothing of theirs."""
    params = spark.range(50).select(F.col("id").alias("feature_id"), F.array(*[F.array(*[F.lit(float(k + j)) for j in range(3)]) for k in range(4)]).alias("beta"))
    beta = mo.effects_long(params, list("abcd"), ["T1", "T2", "T12"])
    lfc = beta.withColumnRenamed("beta", "lfc")
    rows = di.effect_concordance(lfc.select("*"), beta)
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {(r.grp, r.condition, r.n) for r in rows.collect()} == {(g, t, 50) for g in "abcd" for t in ("T1", "T2", "T12")}


def test_pairs_of_features_with_one_key_are_not_compared(spark):
    features = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (2, "a", 1), (2, "b", 2), (3, None, 1), (None, "b", 2), (4, "c", 3)], "feature_id int, k string, s int")
    edges = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("a", 1, 11), ("b", 2, 10), ("b", 2, 12), ("c", 3, 99), ("b", 2, None)], "k string, s int, set_id int")
    allowed = spark.createDataFrame([(10,), (11,), (12,), (12,), (None,)], "set_id int")
    found = jo.upstream_sets(features, edges, allowed, ["k", "s"])
    assert sorted(tuple(r) for r in found.collect() if r.feature_id) == [(1, 10), (1, 11), (2, 10), (2, 11), (2, 12)]
    assert sorted(r.set_id for r in found.collect() if r.feature_id is None) == [10, 12]
    one = found._jdf.queryExecution().optimizedPlan().children().apply(0).toString()
    assert not re.search(r"Aggregate \[feature_id#\d+, set_id#\d+\]", one)


def test_expected_values_meet_once_by_feature(spark):
    profiles = spark.range(40).select((F.col("id") % 8).alias("feature_id"), F.concat(F.lit("g"), (F.col("id") / 8).cast("int")).alias("grp"), F.col("id").cast("double").alias("value"))
    fractions = spark.range(5).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("grp"), F.explode(F.array(F.lit("s"), F.lit("t"))).alias("sample_id"), F.lit(0.2).alias("fraction"))
    mu = di.mixed_mean(profiles, fractions)
    assert str(mu._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning") == 1
    assert {(r.feature_id, round(r.mu, 9)) for r in mu.collect()} == {(f, float(f + 16)) for f in range(8)}
