"""The line search of the fit: what it costs, and that its quick power never turns a decision."""

import numpy as np

from foldwise.operators import kernel as kn
from tests.test_models import P, hyper, make


def test_line_search_takes_no_full_power_per_trial(monkeypatch):
    d, y, base, r = make(40)
    seen = []
    exact = kn.mean_term
    monkeypatch.setattr(kn, "mean_term", lambda *a: seen.append(len(a[0])) or exact(*a))
    kn.inner(kn.Params.zeros(40, 3), hyper(40), d, y, base, r, P)
    # Once an iteration for the rows still in the batch, and for trials that rounding could turn.
    assert sum(seen) <= 1.5 * kn.INNER_ITER * 40 and len(seen) <= 2 * kn.INNER_ITER


def test_ties_are_decided_by_the_full_power():
    rng = np.random.default_rng(1)
    y, mu = rng.gamma(2, 5, (300, 24)) * (rng.random((300, 24)) < 0.7), rng.gamma(2, 5, (300, 24))
    for p in (1.5, 1.3):
        own = 2 * kn.own_term(y, p).sum(axis=1)
        dev = own + 2 * np.where(y > 0, kn.mean_term(y, mu, p), 0.0).sum(axis=1)
        for before in (dev, np.nextafter(dev, np.inf), np.nextafter(dev, -np.inf), np.full(300, np.inf), np.full(300, np.nan)):
            assert (kn._below(own, y / (1 - p), y, mu, p, before) == (dev < before)).all()


def test_fit_does_not_depend_on_the_layout_of_the_design():
    d, y, base, r = make(12)
    turned = kn.Design(*[np.asfortranarray(x) for x in (d.fractions, d.factors, d.blocks)], d.condition)
    a, b = (kn.fit(hyper(12), x, y, base, r, P, outer=2) for x in (d, turned))
    assert np.allclose(a.beta, b.beta, rtol=1e-5, atol=1e-6) and np.allclose(a.phi, b.phi, rtol=1e-6)
