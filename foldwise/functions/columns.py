"""Scalar formulas as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Evidence tiers of the median absolute fold change.
TIER_BOUNDS = (0.5, 0.75)
# Fixed value: smallest fitted mean.
MU_FLOOR = 1e-10


def log2_fold_change(fg: Column, bg: Column) -> Column:
    """log2((fg + 1) / (bg + 1))."""
    return F.log2((fg + 1) / (bg + 1))


def clean(value: Column) -> Column:
    """NaN and infinities become null, the only missing value inside the library."""
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.when(~F.isnan(value) & ~infinite, value)


def optional_double(text: Column) -> Column:
    """Number in a text cell; blank, NA, NaN and nan are missing."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin("", "NA", "NaN", "nan"), trimmed.try_cast("double"))


def gene_case(symbol: Column, organism: str = "Mouse") -> Column:
    """Upper case for human symbols; capitalised for mouse."""
    if organism == "Human":
        return F.upper(symbol)
    return F.concat(F.upper(F.left(symbol, F.lit(1))), F.lower(F.substring(symbol, F.lit(2), F.length(symbol))))


def evidence_tier(median: Column, bounds: tuple[float, float] = TIER_BOUNDS) -> Column:
    return (
        F.when(median.isNull(), F.lit(None).cast("string"))
        .when(median >= bounds[1], "Strong")
        .when(median >= bounds[0], "Moderate")
        .otherwise("Subtle")
    )


def fold_magnitude(a: Column, b: Column) -> Column:
    """max(a/b, b/a); 0 when either side is missing or zero."""
    ratio = F.try_divide(a, b)
    return F.coalesce(F.when(ratio != 0, F.greatest(ratio, F.try_divide(F.lit(1.0), ratio))), F.lit(0.0))


def tier_score(lff: Column, bins: int = 5, limit: float = 2.0) -> Column:
    """Centred bin of ``lff`` over [-limit, limit], scaled to [-1, 1]; 0 where missing."""
    width = 2 * limit / bins
    inner = [-limit + width * i for i in range(1, bins)]
    step = sum((F.when(F.coalesce(lff, F.lit(0.0)) >= F.lit(e), 1).otherwise(0) for e in inner[1:]),
               F.when(F.coalesce(lff, F.lit(0.0)) >= F.lit(inner[0]), 1).otherwise(0))
    centre = (bins - 1) / 2.0
    return F.when(lff.isNull(), F.lit(0.0)).otherwise((step - centre) / max(centre, 1.0))


# ---- Tweedie family -------------------------------------------------------

def tweedie_variance(mu: Column, p) -> Column:
    return F.pow(F.greatest(mu, F.lit(MU_FLOOR)), _lit(p))


def tweedie_deviance(y: Column, mu: Column, p) -> Column:
    """Unit deviance for power 1 < p < 2."""
    p = _lit(p)
    mu = F.greatest(mu, F.lit(MU_FLOOR))
    y = F.greatest(y, F.lit(0.0))
    own = F.when(y > 0, F.pow(y, 2 - p) / ((1 - p) * (2 - p))).otherwise(F.lit(0.0))
    return 2 * (own - y * F.pow(mu, 1 - p) / (1 - p) + F.pow(mu, 2 - p) / (2 - p))


def tweedie_residual(y: Column, mu: Column, p) -> Column:
    return F.signum(y - mu) * F.sqrt(F.greatest(tweedie_deviance(y, mu, p), F.lit(0.0)))


def _saddlepoint(y: Column, mu: Column, phi: Column, p) -> Column:
    spread = F.lit(2 * math.pi) * phi * tweedie_variance(y, p)
    return -tweedie_deviance(y, mu, p) / (2 * phi) - 0.5 * F.ln(spread)


def tweedie_loglik(y: Column, mu: Column, phi: Column, p) -> Column:
    """Log density of one observation: point mass at zero, saddlepoint above."""
    mu = F.greatest(mu, F.lit(MU_FLOOR))
    zero = -F.pow(mu, 2 - _lit(p)) / (phi * (2 - _lit(p)))
    return F.when(y <= 0, zero).otherwise(_saddlepoint(y, mu, phi, p))


def positive_loglik(y: Column, mu: Column, phi: Column, p) -> Column:
    """Saddlepoint log density of a positive observation, 0 for a zero."""
    return F.when(y > 0, _saddlepoint(y, F.greatest(mu, F.lit(MU_FLOOR)), phi, p)).otherwise(F.lit(0.0))


def dropout_probability(gamma0: Column, gamma1: Column, log_mu: Column) -> Column:
    logit = F.greatest(F.least(gamma0 + gamma1 * log_mu, F.lit(20.0)), F.lit(-20.0))
    return 1 / (1 + F.exp(-logit))


def hurdle_loglik(y: Column, mu: Column, phi: Column, p, gamma0: Column, gamma1: Column) -> Column:
    """One observation of the hurdle model: dropout, or zero-truncated Tweedie."""
    p = _lit(p)
    log_mu = F.ln(F.greatest(mu, F.lit(MU_FLOOR)))
    drop = dropout_probability(gamma0, gamma1, log_mu)
    drop = F.greatest(F.least(drop, F.lit(1 - 1e-10)), F.lit(1e-10))
    positive = 1 - F.exp(-F.pow(mu, 2 - p) / (phi * (2 - p)))
    seen = F.ln(1 - drop) + _saddlepoint(y, mu, phi, p) - F.ln(F.greatest(positive, F.lit(1e-30)))
    return F.when(y <= 0, F.ln(drop)).otherwise(seen)


def group_prox(delta: list[Column], threshold: Column, eta: float) -> list[Column]:
    """Group shrinkage of three effects; the third counts sqrt(eta) times in the norm."""
    scale = math.sqrt(eta)
    norm = F.sqrt(delta[0] ** 2 + delta[1] ** 2 + (delta[2] * scale) ** 2)
    shrink = F.when(norm <= threshold, F.lit(0.0)).otherwise(1 - F.try_divide(threshold, norm))
    return [d * shrink for d in delta]


def adaptive_weight(score: Column, gamma: float, epsilon: float = 1e-6) -> Column:
    """1 / (score^gamma + epsilon); uniform when gamma is 0."""
    return F.lit(1.0) if gamma == 0 else 1 / (F.pow(score, F.lit(gamma)) + epsilon)


def _lit(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
