"""The batched fit against a plain per-feature loop, and the jobs around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import kernel as kn
from foldwise.operators import models as mo

P, LAM, LAM_RHO, ETA = 1.5, 0.4, 0.1, 2.0


def make(n_features=10, zero_share=0.1, seed=3):
    rng = np.random.default_rng(seed)
    condition = np.tile(np.arange(4), 6)
    factors = np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 1)], float)[condition]
    time = np.tile(np.repeat([0, 1, 2], 4), 2)
    blocks = np.column_stack([np.repeat([1, 0], 12), time == 1, time == 2]).astype(float)
    fractions = rng.dirichlet(np.ones(4) * 8, 24)
    d = kn.Design(fractions, factors, blocks, np.array(["C", "T1", "T2", "T12"])[condition])
    base = rng.gamma(4, 5, (n_features, 4))
    r = rng.normal(0, 0.5, (n_features, 4, 24))
    y = rng.gamma(6, base @ fractions.T / 6)
    y[rng.random(y.shape) < zero_share] = 0
    return d, y, base, r


def plain_mu(th, rho, d, base, r):
    mu, s = np.zeros(24), np.zeros((4, 24))
    for i in range(24):
        for k in range(4):
            v = base[k] + th[:3] @ d.blocks[i] + rho * r[k, i]
            if k < 3:
                v += (th[3 + 3 * k: 6 + 3 * k] / d.scale[k]) @ d.factors[i]
            s[k, i] = v
            mu[i] += d.fractions[i, k] * max(v, 0)
    return np.maximum(mu, 1e-10), s


def plain_dev(y, mu):
    m, v = mu[y > 0], y[y > 0]
    return float(np.sum(2 * (v ** (2 - P) / ((1 - P) * (2 - P)) - v * m ** (1 - P) / (1 - P) + m ** (2 - P) / (2 - P))))


def plain_inner(th, rho, phi, d, y, base, r):
    previous = np.inf
    for _ in range(kn.INNER_ITER):
        mu, s = plain_mu(th, rho, d, base, r)
        jac = np.zeros((24, 12))
        for i in range(24):
            for k in range(4):
                if s[k, i] > 0:
                    jac[i, :3] += d.fractions[i, k] * d.blocks[i]
                    if k < 3:
                        jac[i, 3 + 3 * k: 6 + 3 * k] = d.fractions[i, k] / d.scale[k] * d.factors[i]
        score = np.where(y > 0, (y - mu) / (phi * mu ** (P - 1)), 0)
        w = np.where(y > 0, mu ** (2 - P) / phi, 0)
        move = np.linalg.solve(jac.T @ (w[:, None] * jac) + 1e-8 * np.eye(12), jac.T @ score)
        step = 1.0
        for _ in range(10):
            if plain_dev(y, plain_mu(th + step * move, rho, d, base, r)[0]) < previous or step < 1e-4:
                break
            step *= 0.5
        th = th + step * move
        for k in range(3):
            g = th[3 + 3 * k: 6 + 3 * k].copy()
            scaled = g * np.array([1, 1, np.sqrt(ETA)])
            norm, tau = np.linalg.norm(scaled), step * LAM * np.sqrt(3)
            th[3 + 3 * k: 6 + 3 * k] = 0 if norm <= tau else g * (1 - tau / norm)
        dev = plain_dev(y, plain_mu(th, rho, d, base, r)[0])
        if np.isfinite(previous) and abs(previous - dev) / (abs(previous) + 1e-10) < kn.INNER_TOL:
            break
        previous = dev
    return th


def plain_round(d, y, base, r):
    """One outer round: inner fit, rho, phi."""
    v = y[y > 0]
    phi = max(np.var(v) / np.mean(v) ** P, 1e-6)
    th = plain_inner(np.zeros(12), 0.0, phi, d, y, base, r)
    mu, s = plain_mu(th, 0.0, d, base, r)
    slope = np.array([sum(d.fractions[i, k] * r[k, i] * (s[k, i] > 0) for k in range(4)) for i in range(24)])
    grad = np.sum(np.where(y > 0, (y - mu) / (phi * mu ** (P - 1)), 0) * slope)
    curve = -np.sum(np.where(y > 0, mu ** (2 - P) / phi, 0) * slope**2) - 2 * LAM_RHO
    rho = -grad / curve
    mu, _ = plain_mu(th, rho, d, base, r)
    used = 3 + np.sum(np.abs(th[3:] / np.repeat(d.scale, 3)) > 1e-10)
    phi = max(np.sum(((y - mu) ** 2 / mu**P)[y > 0]) / max((y > 0).sum() - used, 1), 1e-6)
    return th, rho, phi


def hyper(n, groups=3):
    return kn.Hyper(np.full(n, LAM), np.full(n, LAM_RHO), np.full(n, ETA), np.ones((n, groups)))


def test_batch_equals_plain_loop():
    d, y, base, r = make()
    q = kn.fit(hyper(len(y)), d, y, base, r, P, outer=1)
    for j in range(len(y)):
        th, rho, phi = plain_round(d, y[j], base[j], r[j])
        assert q.alpha[j] == pytest.approx(th[:3], rel=1e-5, abs=1e-5)
        assert q.beta[j].ravel() == pytest.approx(th[3:] / np.repeat(d.scale, 3), rel=1e-5, abs=1e-5)
        assert q.rho[j] == pytest.approx(rho, rel=1e-6) and q.phi[j] == pytest.approx(phi, rel=1e-6)


def test_result_does_not_depend_on_the_batch():
    d, y, base, r = make(6)
    whole = kn.fit(hyper(6), d, y, base, r, P, outer=2)
    one = kn.fit(hyper(1), d, y[3:4], base[3:4], r[3:4], P, outer=2)
    assert whole.beta[3] == pytest.approx(one.beta[0], rel=1e-8, abs=1e-9)


def test_feature_without_values_stays_at_zero():
    d, y, base, r = make(3)
    y[1] = 0
    q = kn.fit(hyper(3), d, y, base, r, P, outer=3)
    assert q.rho[1] == 0 and q.phi[1] == 1 and not q.beta[1].any()


def test_large_penalty_removes_all_groups():
    d, y, base, r = make(5)
    h = hyper(5)
    h.lam[:] = 1e9
    assert not kn.fit(h, d, y, base, r, P, outer=2).beta.any()


def test_dropout_fit_is_a_stationary_point():
    rng = np.random.default_rng(0)
    mu = np.exp(rng.normal(0, 1, (4, 200)))
    y = np.where(rng.random(mu.shape) < 1 / (1 + np.exp(0.5 + 0.8 * np.log(mu))), 0, 1.0)
    g = kn.dropout_fit(y, mu)
    left = (y <= 0) - 1 / (1 + np.exp(-(g[:, :1] + g[:, 1:] * np.log(mu))))
    assert np.abs(left.sum(axis=1)).max() < 1e-5 and np.abs((left * np.log(mu)).sum(axis=1)).max() < 1e-5


@pytest.fixture(scope="module")
def packed(spark):
    d, y, base, r = make(30)
    data = [(j, j % 2, y[j].tolist(), base[j].tolist(), r[j].ravel().tolist()) for j in range(30)]
    df = spark.createDataFrame(data, "feature_id int, stratum int, y array<double>, base array<double>, r array<double>")
    return df, d, y, base, r


def test_spark_fit_equals_kernel(packed):
    df, d, y, base, r = packed
    got = mo.fit_features(df, d, LAM, LAM_RHO, ETA, np.ones(3), P, outer=2).orderBy("feature_id").toPandas()
    q = kn.fit(hyper(30), d, y, base, r, P, outer=2)
    assert np.array(got["phi"]) == pytest.approx(q.phi, rel=1e-6)


def test_cross_validation_sums_held_out_deviance(packed):
    df, d, y, base, r = packed
    got = mo.loco_cv(df, d, {0.5: np.ones(3)}, [LAM], [LAM_RHO], [ETA], [0.5], P).first()
    total = 0.0
    for fold in sorted(set(d.condition)):
        keep = d.condition != fold
        q = kn.fit(hyper(30), d.subset(keep), y[:, keep], base, r[:, :, keep], P, outer=mo.CV_OUTER)
        total += kn.deviance(y[:, ~keep], kn.mean(q, d.subset(~keep), base, r[:, :, ~keep]), P).sum()
    assert got.mean_deviance == pytest.approx(total / 4, rel=1e-4)


def test_grid_edges():
    assert mo.at_grid_edge({"lambda": 1.0, "eta": 2.5}, {"lambda": [1.0, 2.0, 3.0], "eta": [2.0, 2.5, 3.0]}) == ["lambda"]


def test_simulation_repeats_and_recovers_shape(packed):
    df, d, *_ = packed
    params = mo.fit_features(df, d, LAM, LAM_RHO, ETA, np.ones(3), P, outer=2)
    again = [mo.synthesise(df, params, d, "mdes", P).orderBy("feature_id").collect() for _ in range(2)]
    assert again[0] == again[1]
    with pytest.raises(ValueError):
        mo.synthesise(df, params, d, "unknown", P)


def test_permuted_design_keeps_blocks():
    d, *_ = make(1)
    moved = mo.permuted_conditions(d, 5)
    assert (moved.fractions == d.fractions).all() and sorted(moved.condition) == sorted(d.condition)
    for block in np.unique(d.blocks, axis=0):
        rows = (d.blocks == block).all(axis=1)
        assert sorted(moved.condition[rows]) == sorted(d.condition[rows])


def test_perturbation_counts(packed):
    df, d, *_ = packed
    params = mo.fit_features(df, d, LAM, LAM_RHO, ETA, np.ones(3), P, outer=2)
    got = mo.perturbation_audit(df, params, d, ["a", "b", "c"], LAM, LAM_RHO, ETA, np.ones(3), P, sigmas=[0.05], n=2).collect()
    assert len(got) == 3 and all(0 <= r.mean_collapse_rate <= 1 and r.n_features == 30 and r.n_sensitive <= r.n_nonzero for r in got)


def test_pooled_slopes(spark):
    rng = np.random.default_rng(4)
    mu = np.exp(rng.normal(0, 1, 3000))
    y = np.where(rng.random(3000) < 1 / (1 + np.exp(0.3 + 1.2 * np.log(mu))), 0.0, 1.0)
    df = spark.createDataFrame([(k % 2, float(a), float(b)) for k, (a, b) in enumerate(zip(y, mu))], "stratum int, y double, mu double")
    for row in mo.pooled_dropout_slopes(df).collect():
        part = np.arange(3000) % 2 == row.stratum
        want = kn.dropout_fit(y[None, part], mu[None, part])[0]
        assert (row.gamma0, row.gamma1) == pytest.approx(tuple(want), rel=1e-5)


def test_compare_flags_differences(spark):
    old = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, 4.0)], "feature_id int, rho double, phi double")
    new = old.withColumn("phi", F.col("phi") + 1e-3)
    got = {r.field: r.passed for r in mo.compare_params(old, new, ["rho", "phi"]).collect()}
    assert got == {"rho": True, "phi": False}
