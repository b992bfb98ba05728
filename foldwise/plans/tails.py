"""Oracle SQL for tail probabilities, by Simpson's rule or by counting."""

from __future__ import annotations

from foldwise.functions.special import NORMAL_A, NORMAL_B, NORMAL_C, NORMAL_D

_STEPS = 2000


def _integral(of: str, to: str) -> str:
    """Integral of ``of`` (in x) from 0 to ``to``."""
    weight = f"(CASE WHEN g.i IN (0, {_STEPS}) THEN 1 WHEN g.i % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(SELECT sum({weight} * {of}) * any_value(step) / 3 FROM (SELECT i, ({to}) / {_STEPS}.0 AS step, ({to}) / {_STEPS}.0 * i AS x FROM range({_STEPS + 1}) r(i)) g)"


def t_two_sided(t: str, df: str) -> str:
    """Student's t with x as the angle whose tangent is t over the root of the degrees of freedom."""
    scale = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    tail = f"greatest(0.0, 1 - 2 * {scale} * {_integral(f'pow(cos(x), ({df}) - 1)', f'atan(abs({t}) / sqrt({df}))')})"
    return f"(CASE WHEN ({t}) IS NOT NULL AND ({df}) >= 1 THEN {tail} END)"


def correlation(r: str, n: str) -> str:
    t = t_two_sided(f"({r}) * sqrt((({n}) - 2) / (1 - ({r}) * ({r})))", f"({n}) - 2")
    return f"(CASE WHEN ({n}) < 3 OR ({r}) IS NULL THEN NULL WHEN 1 - ({r}) * ({r}) <= 0 THEN 0.0 ELSE {t} END)"


def chi2_upper_df3(h: str) -> str:
    return f"greatest(0.0, 1 - sqrt(2 / pi()) * {_integral('x * x * exp(-x * x / 2)', f'sqrt({h})')})"


def chi2_upper(h: str, df: str) -> str:
    """Chi-squared with x as the root of the variable."""
    scale = f"exp((1 - ({df}) / 2.0) * ln(2) - lgamma(({df}) / 2.0))"
    body = f"greatest(0.0, 1 - {scale} * {_integral(f'pow(x, ({df}) - 1) * exp(-x * x / 2)', f'sqrt({h})')})"
    return f"(CASE WHEN ({df}) > 0 AND ({h}) IS NOT NULL THEN {body} END)"


def signed_rank(w: str, n: str) -> str:
    """Twice the share of the sign patterns of ranks 1 to n whose sum is at most ``w``; for few untied differences."""
    below = f"(SELECT count(*) FROM range((1 << ({n})::INTEGER)::BIGINT) m(b) WHERE list_sum(list_transform(range(1, ({n}) + 1), lambda r: r * ((b >> (r - 1)::INTEGER) & 1))) <= ({w}))"
    return f"least(1.0, 2 * {below} / pow(2.0, {n}))"


def _polynomial(coefficients: list[float], x: str) -> str:
    total = f"({coefficients[0]!r})::DOUBLE"
    for k in coefficients[1:]:
        total = f"({total} * {x} + ({k!r})::DOUBLE)"
    return total


def normal_quantile(p: str) -> str:
    q, m = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"({p} - 0.5)"
    tail = f"{_polynomial(NORMAL_C, q)} / {_polynomial([*NORMAL_D, 1.0], q)}"
    centre = f"{_polynomial(NORMAL_A, f'({m} * {m})')} * {m} / {_polynomial([*NORMAL_B, 1.0], f'({m} * {m})')}"
    return f"(CASE WHEN {p} < 0.02425 THEN {tail} WHEN {p} > 0.97575 THEN -({tail}) ELSE {centre} END)"
