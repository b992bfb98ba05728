"""Special functions as Spark SQL expressions (no Python in the executors).

Arguments are SQL texts such as ``"n_up - a_up"``; the ``*_sql`` helpers return
text and the public functions a Column.  Text keeps long formulas cheap to
build, and ``let`` binds a value to a name so that it is computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ln(n!) for n = 0..20.
LN_FACTORIALS = [math.lgamma(n + 1.0) for n in range(21)]

# Coefficients of the rational approximation of the normal
# quantile (P. J. Acklam), absolute relative error below 1.15e-9.
NORMAL_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
NORMAL_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01]
NORMAL_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
NORMAL_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00]

HALF_LN_2PI = f"{0.5 * math.log(2 * math.pi)!r}D"


def let(name: str, body: str, **values: str) -> str:
    """``body`` with ``name.key`` standing for each value."""
    fields = ", ".join(f"'{key}', {text}" for key, text in values.items())
    return f"element_at(transform(array(named_struct({fields})), {name} -> {body}), 1)"


def ln_factorial_sql(n: str) -> str:
    """ln(n!): a literal table up to 20, Stirling's series above."""
    table = "array(" + ", ".join(f"{v!r}D" for v in LN_FACTORIALS) + ")"
    return let("f", f"""CASE WHEN f.x <= 20 THEN element_at({table}, cast(f.x AS int) + 1)
        ELSE (f.x + 0.5D) * ln(f.x) - f.x + {HALF_LN_2PI} + 1 / (12 * f.x) - 1 / (360 * pow(f.x, 3)) + 1 / (1260 * pow(f.x, 5)) END""",
        x=f"cast({n} AS double)")


def ln_gamma_sql(x: str) -> str:
    """ln Gamma(x) for x > 0: Stirling's series, after a shift by 10 for small x."""
    series = f"""(g.y - 0.5D) * ln(g.y) - g.y + {HALF_LN_2PI} + 1 / (12 * g.y) - 1 / (360 * pow(g.y, 3)) + 1 / (1260 * pow(g.y, 5)) - 1 / (1680 * pow(g.y, 7))
        - CASE WHEN g.y > g.x THEN aggregate(sequence(0, 9), 0D, (total, k) -> total + ln(g.x + k)) ELSE 0D END"""
    return let("g", series, x=x, y=f"CASE WHEN {x} < 10 THEN {x} + 10 ELSE {x} END")


def _point_sql(x: str, hits: str, drawn: str, total: str) -> str:
    """Hypergeometric P(X = x)."""
    f = ln_factorial_sql
    return (f"exp({f(hits)} + {f(f'{total} - {hits}')} + {f(drawn)} + {f(f'{total} - {drawn}')} - {f(total)} - {f(x)}"
            f" - {f(f'{hits} - {x}')} - {f(f'{drawn} - {x}')} - {f(f'{total} - {hits} - {drawn} + {x}')})")


def _series_sql(steps: str, ratio: str) -> str:
    """1 + r1 + r1 r2 + ... over ``steps`` terms; ``ratio`` gives r_i in terms of i."""
    total = f"""aggregate(sequence(1L, cast({steps} AS bigint)), named_struct('term', 1D, 'total', 1D), (s, i) ->
        element_at(transform(array(s.term * ({ratio})), t -> named_struct('term', t, 'total', s.total + t)), 1), s -> s.total)"""
    return f"(CASE WHEN {steps} >= 1 THEN {total} ELSE 1D END)"


def hypergeometric_upper(a: str, b: str, c: str, d: str) -> Column:
    """One-sided exact test of the 2x2 table [[a, b], [c, d]]: P(X >= a).

    Sums the tail that does not hold the mean, term by term from its edge.  Terms
    shrink at least as fast as a normal tail there, so 12 standard deviations
    plus a constant reach below double precision however large the table is.
    """
    a, b, c, d = (f"cast({v} AS double)" for v in (a, b, c, d))
    up = _point_sql("h.a", "h.hits", "h.drawn", "h.total") + " * " + _series_sql(
        "least(h.hits - h.a, h.drawn - h.a, h.reach)", "(h.hits - h.a - i + 1) * (h.drawn - h.a - i + 1) / ((h.a + i) * (h.total - h.hits - h.drawn + h.a + i))")
    down = _point_sql("(h.a - 1)", "h.hits", "h.drawn", "h.total") + " * " + _series_sql(
        "least(h.a - 1 - h.floor, h.reach)", "(h.a - i) * (h.total - h.hits - h.drawn + h.a - i) / ((h.hits - h.a + 1 + i) * (h.drawn - h.a + 1 + i))")
    tail = f"CASE WHEN h.a <= h.floor THEN 1D WHEN h.a > h.mean THEN {up} ELSE 1D - {down} END"
    scaled = let("h", f"greatest(least({tail}, 1D), 0D)", a="m.a", hits="m.hits", drawn="m.drawn", total="m.total", mean="m.drawn * m.hits / m.total",
                 floor="greatest(m.hits + m.drawn - m.total, 0D)",
                 reach="60 + ceil(12 * sqrt(m.drawn * m.hits / m.total * (1 - m.hits / m.total) * (m.total - m.drawn) / greatest(m.total - 1, 1D)))")
    return F.expr(let("m", scaled, a=a, hits=f"{a} + {c}", drawn=f"{a} + {b}", total=f"{a} + {b} + {c} + {d}"))


def _poly_sql(coefficients: list[float], x: str) -> str:
    total = f"({coefficients[0]!r}D)"
    for k in coefficients[1:]:
        total = f"({total} * {x} + ({k!r}D))"
    return total


def normal_quantile(p: str) -> Column:
    """Inverse of the standard normal distribution function."""
    edge = 0.02425
    tail = let("t", f"{_poly_sql(NORMAL_C, 't.q')} / {_poly_sql([*NORMAL_D, 1.0], 't.q')}", q="sqrt(-2 * ln(least(n.p, 1 - n.p)))")
    centre = let("t", f"{_poly_sql(NORMAL_A, 't.s')} * t.m / {_poly_sql([*NORMAL_B, 1.0], 't.s')}", m="n.p - 0.5D", s="pow(n.p - 0.5D, 2)")
    body = f"CASE WHEN n.p < {edge}D THEN {tail} WHEN n.p > {1 - edge}D THEN -({tail}) ELSE {centre} END"
    return F.expr(let("n", body, p=f"cast({p} AS double)"))


def beta_regularised_sql(a: str, b: str, x: str) -> str:
    """Regularised incomplete beta function by its continued fraction.

    The fraction needs on the order of sqrt(a + b) terms and converges fast on
    one side of the mean; the other side is its mirror image.
    """
    even = "m * (q.b - m) * q.x / ((q.a + 2 * m - 1) * (q.a + 2 * m))"
    odd = "-(q.a + m) * (q.a + q.b + m) * q.x / ((q.a + 2 * m) * (q.a + 2 * m + 1))"
    # Step k = 1, 2, 3, ... takes the even, then the odd coefficient of m = 1, 2, ...
    coefficient = f"element_at(transform(array(cast(floor((k + 1) / 2) AS double)), m -> CASE WHEN k % 2 = 1 THEN {even} ELSE {odd} END), 1)"
    step = let("w", "named_struct('c', w.c, 'd', w.d, 'h', w.h * w.c * w.d)", c=f"1 + z / s.c", d="1 / (1 + z * s.d)", h="s.h")
    start = "element_at(transform(array(1 / (1 - (q.a + q.b) * q.x / (q.a + 1))), d -> named_struct('c', 1D, 'd', d, 'h', d)), 1)"
    fraction = f"""aggregate(sequence(1, 100 + 2 * cast(ceil(5 * sqrt(q.a + q.b)) AS int)), {start}, (s, k) ->
        element_at(transform(array({coefficient}), z -> {step}), 1), s -> s.h)"""
    scale = f"exp({ln_gamma_sql('q.a + q.b')} - {ln_gamma_sql('q.a')} - {ln_gamma_sql('q.b')} + q.a * ln(q.x) + q.b * ln(1 - q.x)) / q.a"
    part = let("q", f"{scale} * {fraction}", a="if(v.near, v.a, v.b)", b="if(v.near, v.b, v.a)", x="if(v.near, v.x, 1 - v.x)")
    body = f"CASE WHEN v.x <= 0 THEN 0D WHEN v.x >= 1 THEN 1D WHEN v.near THEN {part} ELSE 1 - {part} END"
    return let("u", let("v", body, a="u.a", b="u.b", x="u.x", near="u.x < (u.a + 1) / (u.a + u.b + 2)"), a=a, b=b, x=x)


def normal_two_sided_sql(z: str) -> str:
    """2(1 - Phi(|z|)): series near zero, continued fraction in the tail."""
    pdf = f"exp(-e.x * e.x / 2) / {math.sqrt(2 * math.pi)!r}D"
    # Phi(x) - 1/2 = pdf(x) * (x + x^3/3 + x^5/15 + ...)
    near = f"1 - 2 * {pdf} * e.x * {_series_sql('120', 'e.x * e.x / (2 * i + 1)')}"
    fraction = "aggregate(sequence(60, 1, -1), e.x, (r, k) -> e.x + k / r)"
    return let("e", f"CASE WHEN e.x < 3 THEN {near} ELSE 2 * {pdf} / {fraction} END", x=f"abs({z})")


def normal_two_sided(z: str) -> Column:
    return F.expr(normal_two_sided_sql(z))


def t_two_sided_sql(t: str, df: str) -> str:
    """Two-sided p of Student's t, by the same formula at any degrees of freedom."""
    return let("y", beta_regularised_sql("y.n / 2", "0.5D", "y.n / (y.n + y.t * y.t)"), t=t, n=f"cast({df} AS double)")


def t_two_sided(t: str, df: str) -> Column:
    return F.expr(t_two_sided_sql(t, df))


def correlation_p(r: str, n: str) -> Column:
    """Two-sided p of a correlation of ``n`` pairs."""
    t = t_two_sided_sql(f"{r} * sqrt(({n} - 2) / (1 - {r} * {r}))", f"{n} - 2")
    return F.expr(f"CASE WHEN {n} < 3 OR {r} IS NULL THEN NULL WHEN 1 - {r} * {r} <= 0 THEN 0D ELSE {t} END")


def signed_rank_p(w: str, n: str, variance: str, exact: str) -> Column:
    """Two-sided p of the Wilcoxon signed-rank statistic ``w`` (the smaller rank sum).

    Exact for up to 50 untied differences, from the distribution of rank sums
    built one rank at a time; otherwise normal with the given variance.
    """
    counts = f"""aggregate(sequence(1, cast({n} AS int)), array(1D), (c, i) -> transform(sequence(0, size(c) - 1 + i),
        j -> coalesce(get(c, j), 0D) + coalesce(get(c, j - i), 0D)))"""
    below = f"aggregate(slice({counts}, 1, cast({w} AS int) + 1), 0D, (s, v) -> s + v)"
    large = normal_two_sided_sql(f"(({w}) - ({n}) * (({n}) + 1) / 4) / sqrt({variance})")
    return F.expr(f"CASE WHEN {n} < 1 THEN NULL WHEN ({exact}) AND {n} <= 50 THEN least(2 * {below} / pow(2D, {n}), 1D) ELSE {large} END")


def chi2_upper_df3(x: str) -> Column:
    """Upper tail of chi-squared with three degrees of freedom (closed form)."""
    return F.expr(f"{normal_two_sided_sql(f'sqrt({x})')} + sqrt(2 * ({x}) / {math.pi!r}D) * exp(-({x}) / 2)")


def gamma_upper_sql(a: str, x: str) -> str:
    """Regularised upper incomplete gamma function Q(a, x).

    Below a + 1 the series of its complement, above it the continued fraction from its
    end; either needs a number of terms of the order of sqrt(a) beyond a constant.
    """
    terms = "cast(200 + ceil(8 * sqrt(j.a)) AS bigint)"
    scale = f"exp(j.a * ln(j.x) - j.x - {ln_gamma_sql('j.a')})"
    series = f"1 - {scale} / j.a * {_series_sql(terms, 'j.x / (j.a + i)')}"
    fraction = f"aggregate(sequence({terms}, 1L, -1L), j.x + 2 * {terms} + 1 - j.a, (f, k) -> j.x + 2 * k - 1 - j.a - k * (k - j.a) / f)"
    body = f"CASE WHEN j.x <= 0 THEN 1D WHEN j.x < j.a + 1 THEN greatest({series}, 0D) ELSE {scale} / {fraction} END"
    return let("j", body, a=f"cast({a} AS double)", x=f"cast({x} AS double)")


def chi2_upper(x: str, df: str) -> Column:
    """Upper tail of chi-squared with any positive degrees of freedom; null without any."""
    tail = gamma_upper_sql(f"({df}) / 2D", f"({x}) / 2")
    return F.expr(f"CASE WHEN ({df}) > 0 AND ({x}) IS NOT NULL THEN {tail} END")
