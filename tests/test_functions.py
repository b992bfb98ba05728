"""Special functions and model formulas against independent computations."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import columns as c
from foldwise.functions import special as sp


def evaluate(spark, *columns):
    return spark.range(1).select(*[x.alias(f"v{k}") for k, x in enumerate(columns)]).first()


def exact_tail(a, b, cc, d):
    hits, drawn, total = a + cc, a + b, a + b + cc + d
    ways = sum(math.comb(hits, x) * math.comb(total - hits, drawn - x) for x in range(a, min(hits, drawn) + 1))
    return float(Fraction(ways, math.comb(total, drawn)))


@pytest.mark.parametrize("table", [(3, 7, 5, 85), (0, 10, 4, 50), (10, 0, 0, 5), (1, 9, 30, 60), (40, 60, 200, 3000), (5, 95, 300, 2700), (2, 8, 9, 1), (0, 0, 3, 5)])
def test_hypergeometric_tail(spark, table):
    got = evaluate(spark, sp.hypergeometric_upper(*map(str, table)))[0]
    assert got == pytest.approx(exact_tail(*table), rel=1e-9)


def test_tail_of_a_huge_table_is_finite(spark):
    got = evaluate(spark, sp.hypergeometric_upper("500000L", "499500000L", "9000000L", "9490500000L"))[0]
    assert 0.0 <= got <= 1.0


@pytest.mark.parametrize("z", [0.0, 0.5, 1.96, 2.99, 3.01, 6.0, 10.0])
def test_normal_tail(spark, z):
    assert evaluate(spark, sp.normal_two_sided(f"{z}D"))[0] == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)


@pytest.mark.parametrize("p", [1e-6, 0.01, 0.3, 0.5, 0.975, 0.9999])
def test_normal_quantile(spark, p):
    z = evaluate(spark, sp.normal_quantile(f"cast({p!r} AS double)"))[0]
    assert 0.5 * math.erfc(-z / math.sqrt(2)) == pytest.approx(p, rel=1e-6)


@pytest.mark.parametrize("t, df, p", [(0.0, 5, 1.0), (1.0, 1, 0.5), (12.706204736, 1, 0.05), (2.570581836, 5, 0.05), (2.042272456, 30, 0.05), (3.390491, 100, 0.001)])
def test_student_tail(spark, t, df, p):
    assert evaluate(spark, sp.t_two_sided(f"{t}D", str(df)))[0] == pytest.approx(p, rel=1e-5)


def test_chi_squared_tail(spark):
    assert evaluate(spark, sp.chi2_upper_df3("7.814727903D"))[0] == pytest.approx(0.05, rel=1e-8)


@pytest.mark.parametrize("w, n", [(5, 8), (0, 10), (20, 9)])
def test_signed_rank_exact(spark, w, n):
    below = sum(1 for signs in itertools.product([0, 1], repeat=n) if sum(k + 1 for k in range(n) if signs[k]) <= w)
    assert evaluate(spark, sp.signed_rank_p(f"{w}D", f"{n}L", "1D", "true"))[0] == pytest.approx(min(1.0, 2 * below / 2**n))


Y, MU = [0.0, 0.0, 1.5, 3.2, 0.8, 5.0, 0.1, 10.0], [0.5, 0.3, 1.2, 3.0, 1.0, 4.5, 0.2, 9.5]


@pytest.mark.parametrize("p", [1.2, 1.5, 1.8])
def test_tweedie_invariants(spark, p):
    df = spark.createDataFrame(list(zip(Y, MU)), "y double, mu double")
    rows = df.select(
        c.tweedie_deviance(F.col("y"), F.col("mu"), p).alias("d"), c.tweedie_deviance(F.col("y"), F.col("y"), p).alias("own"), "y", "mu",
        c.tweedie_variance(F.col("mu"), p).alias("v"), c.tweedie_loglik(F.col("y"), F.col("mu"), F.lit(1.0), p).alias("ll"),
        c.tweedie_residual(F.col("y"), F.col("mu"), p).alias("r")).collect()
    for row in rows:
        assert row.d >= 0 and math.isfinite(row.ll) and math.isfinite(row.r)
        assert row.v == pytest.approx(row.mu**p)
        if row.y > 0:
            assert row.own == pytest.approx(0, abs=1e-9)
            expected = 2 * (row.y ** (2 - p) / ((1 - p) * (2 - p)) - row.y * row.mu ** (1 - p) / (1 - p) + row.mu ** (2 - p) / (2 - p))
            assert row.d == pytest.approx(expected)


def test_group_shrinkage_extremes(spark):
    delta = [F.lit(1.0), F.lit(0.5), F.lit(0.3)]
    assert list(evaluate(spark, *c.group_prox(delta, F.lit(100.0), 2.0))) == [0, 0, 0]
    assert list(evaluate(spark, *c.group_prox(delta, F.lit(0.0), 2.0))) == pytest.approx([1.0, 0.5, 0.3])


def test_adaptive_weights(spark):
    flat, low, high = evaluate(spark, c.adaptive_weight(F.lit(0.5), 0), c.adaptive_weight(F.lit(0.5), 1.0), c.adaptive_weight(F.lit(0.6), 1.0))
    assert flat == 1.0 and low > high


def test_missing_values(spark):
    df = spark.createDataFrame([(float("nan"), " NA "), (float("inf"), ""), (2.5, "nan"), (None, "1.5")], "v double, t string")
    rows = df.select(c.clean(F.col("v")).alias("v"), c.optional_double(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [(None, None), (None, None), (2.5, None), (None, 1.5)]


def test_labels(spark):
    got = evaluate(spark, c.gene_case(F.lit("AKT1")), c.gene_case(F.lit("akt1"), "Human"), c.evidence_tier(F.lit(0.75)), c.evidence_tier(F.lit(0.6)),
                   c.evidence_tier(F.lit(0.1)), c.evidence_tier(F.lit(None).cast("double")), c.fold_magnitude(F.lit(2.0), F.lit(8.0)), c.fold_magnitude(F.lit(2.0), F.lit(0.0)),
                   c.tier_score(F.lit(0.5)), c.tier_score(F.lit(None).cast("double")))
    assert list(got) == ["Akt1", "AKT1", "Strong", "Moderate", "Subtle", None, 4.0, 0.0, 0.5, 0.0]
    assert np.digitize(0.5, np.linspace(-2, 2, 6)[1:-1]) == 3
