"""The per-feature hurdle fit, vectorised over a batch of features.

A feature is a row: y (samples), base (groups), r (groups x samples).  Every
array below has the batch as its first axis.  This is the only numeric code
outside Spark expressions; tasks call it on Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

# Iteration limits and tolerances of the fit.
INNER_ITER, INNER_TOL = 50, 1e-6
OUTER_ITER, OUTER_TOL = 40, 1e-4
MU_FLOOR = 1e-10
ROOT3 = 3.0**0.5
# Relative gap of two deviances that rounding cannot bridge.
ROUNDING = 1e-11


@dataclass(frozen=True)
class Design:
    """What all features share: one row per sample."""

    fractions: np.ndarray  # samples x groups; the last group has no condition effects
    factors: np.ndarray    # samples x 3 (first, second, both)
    blocks: np.ndarray     # samples x 3 (female, time2, time3)
    condition: np.ndarray  # sample labels
    mean_fraction: np.ndarray | None = None  # per estimated group, if not that of these samples

    @property
    def groups(self) -> int:
        return self.fractions.shape[1] - 1

    @property
    def scale(self) -> np.ndarray:
        mean = self.fractions[:, :-1].mean(axis=0) if self.mean_fraction is None else self.mean_fraction
        return np.maximum(mean, 1e-10)

    def subset(self, keep: np.ndarray) -> "Design":
        return Design(self.fractions[keep], self.factors[keep], self.blocks[keep], self.condition[keep], self.mean_fraction)


@dataclass
class Params:
    """Fitted values of a batch; ``beta`` is (features, groups, 3)."""

    beta: np.ndarray
    alpha: np.ndarray
    rho: np.ndarray
    gamma: np.ndarray
    phi: np.ndarray
    converged: np.ndarray

    @staticmethod
    def zeros(n: int, groups: int) -> "Params":
        return Params(np.zeros((n, groups, 3)), np.zeros((n, 3)), np.zeros(n), np.zeros((n, 2)), np.ones(n), np.zeros(n, bool))

    def take(self, rows: np.ndarray) -> "Params":
        return Params(*[getattr(self, f)[rows] for f in ("beta", "alpha", "rho", "gamma", "phi", "converged")])

    def put(self, rows: np.ndarray, other: "Params") -> None:
        for f in ("beta", "alpha", "rho", "gamma", "phi", "converged"):
            getattr(self, f)[rows] = getattr(other, f)


def signal(q: Params, d: Design, base: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Unclipped group signal: (features, groups, samples)."""
    s = base[:, :, None] + (q.alpha @ d.blocks.T)[:, None, :] + q.rho[:, None, None] * r
    s[:, :-1] += q.beta @ d.factors.T
    return s


def mix(s: np.ndarray, d: Design) -> np.ndarray:
    return np.maximum((np.maximum(s, 0.0) * d.fractions.T).sum(axis=1), MU_FLOOR)


def mean(q: Params, d: Design, base: np.ndarray, r: np.ndarray) -> np.ndarray:
    return mix(signal(q, d, base, r), d)


def deviance(y: np.ndarray, mu: np.ndarray, p: float) -> np.ndarray:
    """Tweedie unit deviance, 0 where y is not positive."""
    return np.where(y > 0, 2 * (own_term(y, p) + mean_term(y, mu, p)), 0.0)


def own_term(y: np.ndarray, p: float) -> np.ndarray:
    return np.where(y > 0, np.maximum(y, MU_FLOOR) ** (2 - p), 0.0) / ((1 - p) * (2 - p))


def mean_term(y: np.ndarray, mu: np.ndarray, p: float) -> np.ndarray:
    power = mu ** (1 - p)
    return power * (mu / (2 - p) - y / (1 - p))


def shrink(delta: np.ndarray, threshold: np.ndarray, eta: np.ndarray) -> np.ndarray:
    """Group shrinkage; the interaction counts sqrt(eta) times in the norm."""
    weight = np.ones(delta.shape)
    weight[..., 2] = np.sqrt(eta)[:, None]
    norm = np.linalg.norm(delta * weight, axis=-1)
    keep = np.where(norm > threshold, 1 - threshold / np.maximum(norm, 1e-300), 0.0)
    return delta * keep[..., None]


def _solve(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.solve(matrix, vector[..., None])[..., 0]
    except np.linalg.LinAlgError:
        return np.stack([np.linalg.lstsq(m, v, rcond=None)[0] for m, v in zip(matrix, vector)])


@dataclass
class Hyper:
    """Penalties per feature: arrays of length features (omega: features x groups)."""

    lam: np.ndarray
    lam_rho: np.ndarray
    eta: np.ndarray
    omega: np.ndarray

    def take(self, rows: np.ndarray) -> "Hyper":
        return Hyper(self.lam[rows], self.lam_rho[rows], self.eta[rows], self.omega[rows])


def _quick(mu: np.ndarray, power: float) -> np.ndarray:
    """``mu ** power`` up to rounding, by a square root where that does."""
    return 1 / np.sqrt(mu) if power == -0.5 else mu**power


def _below(own: np.ndarray, parts: np.ndarray, y: np.ndarray, mu: np.ndarray, p: float, before: np.ndarray) -> np.ndarray:
    """Which rows have a deviance below ``before``: ``own`` plus twice the sum of the mean's terms at positive y.

    ``parts`` is y / (1 - p).  The quick power decides; rows that rounding could turn are decided by ``mean_term``.
    """
    value = mu / (2 - p)
    value -= parts
    value *= _quick(mu, 1 - p)
    value[y <= 0] = 0.0
    dev = own + 2 * value.sum(axis=1)
    near = np.flatnonzero(np.abs(dev - before) <= ROUNDING * (np.abs(own) + np.abs(dev)))
    if len(near):
        dev[near] = own[near] + 2 * np.where(y[near] > 0, mean_term(y[near], mu[near], p), 0.0).sum(axis=1)
    return dev < before


def inner(q: Params, h: Hyper, d: Design, y: np.ndarray, base: np.ndarray, r: np.ndarray, p: float) -> Params:
    """Penalised scoring for alpha and beta at fixed rho and phi, in delta = scale * beta.

    A line search on the deviance before shrinkage against the previous one
    after it; the signal is linear in the parameters, so a trial step only adds
    a multiple of its change.  Finished features leave the batch.
    """
    out = replace(q, beta=q.beta.copy(), alpha=q.alpha.copy())
    share, blocks, factors, scale = (*map(np.ascontiguousarray, (d.fractions.T, d.blocks.T, d.factors.T)), d.scale)
    # How the products below lie in memory decides the order of their sums: that of the design.
    by_sample = d.blocks.flags.f_contiguous and d.factors.flags.f_contiguous
    own, parts, coupled, phi = 2 * own_term(y, p).sum(axis=1), y / (1 - p), q.rho[:, None, None] * r, q.phi[:, None]
    ridge = 1e-8 * np.eye(3 + 3 * d.groups)

    def mixed(s: np.ndarray) -> np.ndarray:
        """``mix`` of a signal that is not needed any more."""
        np.maximum(s, 0.0, out=s)
        s *= share
        mu = s.sum(axis=1)
        return np.maximum(mu, MU_FLOOR, out=mu)

    live = np.arange(len(y))
    s = signal(out, d, base, r)
    mu = mix(s, d)
    previous = np.full(len(y), np.inf)
    for _ in range(INNER_ITER):
        positive, spread = y > 0, phi * mu ** (p - 1)
        free = (s > 0) * share
        jac = np.empty((len(live), d.groups + 1, 3, y.shape[1]))
        np.multiply(free.sum(axis=1)[:, None, :], blocks, out=jac[:, 0])
        np.multiply((free[:, :-1] / scale[:, None])[:, :, None, :], factors, out=jac[:, 1:])
        jac = jac.reshape(len(live), -1, y.shape[1])
        score = np.where(positive, (y - mu) / spread, 0.0)
        weight = np.where(positive, mu / spread, 0.0)
        flipped = jac if by_sample else np.ascontiguousarray(jac.transpose(0, 2, 1)).transpose(0, 2, 1)
        gram = jac @ (weight[:, None, :] * jac).transpose(0, 2, 1)
        gram += ridge
        move = _solve(gram, (flipped @ score[:, :, None])[..., 0])
        by_beta = move[:, 3:].reshape(len(live), -1, 3) / scale[:, None]
        change = np.repeat((move[:, :3] @ d.blocks.T)[:, None, :], d.groups + 1, axis=1)
        change[:, :-1] += by_beta @ d.factors.T
        step, rows, before = np.ones(len(live)), np.arange(len(live)), previous[live]
        # What a row still searching needs; a halved change is exact.
        trial = (own, parts, y, before, s)
        for _ in range(10):
            found = _below(trial[0], trial[1], trial[2], mixed(trial[4] + change), p, trial[3])
            rows = rows[~found]
            step[rows] *= 0.5
            if not len(rows):
                break
            if found.any():
                trial, change = tuple(a[~found] for a in trial), change[~found]
            change *= 0.5
        beta = (out.beta[live] + step[:, None, None] * by_beta) * scale[:, None]
        out.alpha[live] += step[:, None] * move[:, :3]
        hl = h.take(live)
        out.beta[live] = shrink(beta, step[:, None] * hl.lam[:, None] * hl.omega * ROOT3, hl.eta) / scale[:, None]
        s = base[:, :, None] + (out.alpha[live] @ d.blocks.T)[:, None, :]
        s += coupled
        s[:, :-1] += out.beta[live] @ d.factors.T
        mu = mixed(s.copy())
        dev = own + 2 * np.where(positive, mean_term(y, mu, p), 0.0).sum(axis=1)
        with np.errstate(invalid="ignore"):
            settled = np.isfinite(before) & (np.abs(before - dev) / (np.abs(before) + 1e-10) < INNER_TOL)
        previous[live] = dev
        if settled.any():
            live, own, parts, coupled, phi, y, base, s, mu = (a[~settled] for a in (live, own, parts, coupled, phi, y, base, s, mu))
            if not len(live):
                break
    return out


def coupling(q: Params, h: Hyper, d: Design, y: np.ndarray, base: np.ndarray, r: np.ndarray, p: float) -> np.ndarray:
    """One Newton step for rho under its ridge penalty."""
    s = signal(q, d, base, r)
    mu = mix(s, d)
    slope = ((s > 0) * r * d.fractions.T).sum(axis=1)
    positive = y > 0
    grad = np.where(positive, (y - mu) / (q.phi[:, None] * mu ** (p - 1)) * slope, 0.0).sum(axis=1) - 2 * h.lam_rho * q.rho
    curve = -np.where(positive, mu ** (2 - p) / q.phi[:, None] * slope**2, 0.0).sum(axis=1) - 2 * h.lam_rho
    flat = np.abs(curve) < 1e-15
    new = np.where(flat, q.rho, q.rho - grad / np.where(flat, 1.0, curve))
    return np.where(positive.any(axis=1), new, 0.0)


def dispersion(y: np.ndarray, mu: np.ndarray, p: float, used: np.ndarray) -> np.ndarray:
    """Pearson estimate over positive values."""
    positive = y > 0
    n = positive.sum(axis=1)
    total = np.where(positive, (y - mu) ** 2 / mu**p, 0.0).sum(axis=1)
    return np.where(n == 0, 1.0, np.maximum(total / np.maximum(n - used, 1.0), 1e-6))


def dropout_fit(y: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """Logistic regression of a zero on log mu, per feature: (intercept, slope)."""
    z, x = (y <= 0).astype(float), np.log(np.maximum(mu, MU_FLOOR))
    g = np.zeros((len(y), 2))
    live = np.ones(len(y), bool)
    for _ in range(25):
        pi = 1 / (1 + np.exp(-np.clip(g[:, :1] + g[:, 1:] * x, -20, 20)))
        w = pi * (1 - pi)
        a, b, c = w.sum(axis=1) + 1e-8, (w * x).sum(axis=1), (w * x * x).sum(axis=1) + 1e-8
        u, v = (z - pi).sum(axis=1), ((z - pi) * x).sum(axis=1)
        det = a * c - b * b
        step = np.stack([(c * u - b * v) / det, (a * v - b * u) / det], axis=1)
        step = np.where(live[:, None] & np.isfinite(step), step, 0.0)
        g += step
        live &= np.linalg.norm(step, axis=1) >= 1e-8
        if not live.any():
            break
    return g


def loglik(y: np.ndarray, mu: np.ndarray, phi: np.ndarray, p: float, gamma: np.ndarray) -> np.ndarray:
    """Hurdle log-likelihood: dropout, or zero-truncated Tweedie (saddlepoint)."""
    drop = 1 / (1 + np.exp(-np.clip(gamma[:, :1] + gamma[:, 1:] * np.log(mu), -20, 20)))
    drop = np.clip(drop, 1e-10, 1 - 1e-10)
    phi = phi[:, None]
    seen = np.log(1 - drop) - deviance(y, mu, p) / (2 * phi) - 0.5 * np.log(2 * np.pi * phi * np.maximum(y, MU_FLOOR) ** p)
    seen -= np.log(np.maximum(1 - np.exp(-mu ** (2 - p) / (phi * (2 - p))), 1e-30))
    return np.where(y > 0, seen, np.log(drop)).sum(axis=1)


def fit(
    h: Hyper, d: Design, y: np.ndarray, base: np.ndarray, r: np.ndarray, p: float,
    start: Params | None = None, outer: int = OUTER_ITER, slope: np.ndarray | None = None,
) -> Params:
    """Alternate the inner fit, rho, phi and the dropout part until the penalised fit settles.

    ``slope`` fixes the dropout slope per feature (the pooled one); the intercept
    is that of the free fit, as in the method being reproduced.
    """
    y = np.nan_to_num(y, nan=0.0)
    if start is None:
        q = Params.zeros(len(y), d.groups)
        positive = y > 0
        n = np.maximum(positive.sum(axis=1), 1)
        m = np.where(positive, y, 0).sum(axis=1) / n
        var = np.where(positive, (y - m[:, None]) ** 2, 0).sum(axis=1) / n
        q.phi = np.where(m > 0, np.maximum(var / np.where(m > 0, m, 1.0) ** p, 1e-6), 1.0)
    else:
        q = start.take(np.arange(len(y)))
        q.converged = np.zeros(len(y), bool)
    live = np.arange(len(y))
    last = np.full(len(y), -np.inf)
    for _ in range(outer):
        w, hl, yl, bl, rl = q.take(live), h.take(live), y[live], base[live], r[live]
        w = inner(w, hl, d, yl, bl, rl, p)
        w.rho = coupling(w, hl, d, yl, bl, rl, p)
        mu = mean(w, d, bl, rl)
        w.phi = dispersion(yl, mu, p, 3.0 + (np.abs(w.beta) > 1e-10).sum(axis=(1, 2)))
        w.gamma = dropout_fit(yl, mu)
        if slope is not None:
            w.gamma[:, 1] = slope[live]
        norms = np.linalg.norm(w.beta, axis=2) * d.scale
        value = loglik(yl, mu, w.phi, p, w.gamma) - hl.lam_rho * w.rho**2 - (hl.lam[:, None] * hl.omega * ROOT3 * norms).sum(axis=1)
        before = last[live]
        with np.errstate(invalid="ignore"):
            w.converged = np.isfinite(before) & (np.abs(value - before) / (np.abs(before) + 1e-10) < OUTER_TOL)
        last[live] = value
        q.put(live, w)
        live = live[~w.converged]
        if not len(live):
            break
    return q
