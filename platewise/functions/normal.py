"""Standard normal pdf/cdf as Column expressions (and their DuckDB twins).

Neither Spark nor DuckDB has ``erf``; both sides use the Abramowitz-Stegun 7.1.26
polynomial (|error| <= 1.5e-7) written in the same Horner order, so the two
engines produce the same doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 coefficients.
AS_P = 0.3275911
AS_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
SQRT2 = math.sqrt(2.0)
INV_SQRT_2PI = 1.0 / math.sqrt(2.0 * math.pi)


def erf(x: Column) -> Column:
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    a1, a2, a3, a4, a5 = AS_A
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    y = F.lit(1.0) - poly * F.exp(-(ax * ax))
    return F.when(x < 0, -y).otherwise(y)


def norm_cdf(z: Column) -> Column:
    return F.lit(0.5) * (F.lit(1.0) + erf(z / F.lit(SQRT2)))


def norm_pdf(z: Column) -> Column:
    return F.lit(INV_SQRT_2PI) * F.exp(F.lit(-0.5) * z * z)


TAIL = -4.0  # below it the difference z Phi(z) + phi(z) keeps no digits of the polynomial erf
TAIL_DEPTH = 24  # terms of the continued fraction; 1e-9 relative at the border


def _mills(x: Column) -> Column:
    """(1 - Phi(x)) / phi(x) for x >= 4 by its continued fraction."""
    r = x
    for k in range(TAIL_DEPTH, 0, -1):
        r = x + F.lit(float(k)) / r
    return F.lit(1.0) / r


def _far(z: Column) -> Column:
    return F.greatest(-z, F.lit(-TAIL))


def ei_core(z: Column) -> Column:
    """z Phi(z) + phi(z), with its relative precision kept far below zero."""
    return F.when(z < TAIL, norm_pdf(z) * (F.lit(1.0) - _far(z) * _mills(_far(z)))).otherwise(z * norm_cdf(z) + norm_pdf(z))


def log_ei_core(z: Column) -> Column:
    """ln(z Phi(z) + phi(z)), finite where the value itself underflows."""
    tail = F.lit(math.log(INV_SQRT_2PI)) - F.lit(0.5) * z * z + F.log(F.lit(1.0) - _far(z) * _mills(_far(z)))
    return F.when(z < TAIL, tail).otherwise(F.log(z * norm_cdf(z) + norm_pdf(z)))


def np_ei(mu, var, best, least: float = 1e-12):
    """Expected improvement s (z Phi(z) + phi(z)) in numpy, the same terms as ``ei_core``."""
    import numpy as np

    s = np.sqrt(np.maximum(var, least))
    z = (mu - best) / s
    x = np.abs(z) / SQRT2
    t = 1.0 / (1.0 + AS_P * x)
    a1, a2, a3, a4, a5 = AS_A
    half = 0.5 * t * (a1 + t * (a2 + t * (a3 + t * (a4 + t * a5)))) * np.exp(-x * x)
    pdf = INV_SQRT_2PI * np.exp(-0.5 * z * z)
    out = z * np.where(z < 0, half, 1.0 - half) + pdf
    far = z < TAIL
    if far.any():
        x = -z[far]
        r = x
        for k in range(TAIL_DEPTH, 0, -1):
            r = x + k / r
        out[far] = pdf[far] * (1.0 - x / r)
    return s * out


def _sql_far_gap(z: str) -> str:
    x = f"greatest(-({z}), {-TAIL!r}::DOUBLE)"
    r = "x"
    for k in range(TAIL_DEPTH, 0, -1):
        r = f"(x + {float(k)!r}::DOUBLE / {r})"
    return f"list_transform([{x}], lambda x: 1.0::DOUBLE - x * (1.0::DOUBLE / {r}))[1]"


def sql_ei_core(z: str) -> str:
    return (f"(CASE WHEN {z} < {TAIL!r} THEN {sql_pdf(z)} * {_sql_far_gap(z)} "
            f"ELSE {z} * {sql_cdf(z)} + {sql_pdf(z)} END)")


def sql_log_ei_core(z: str) -> str:
    return (f"(CASE WHEN {z} < {TAIL!r} THEN {math.log(INV_SQRT_2PI)!r}::DOUBLE - 0.5::DOUBLE * ({z}) * ({z}) "
            f"+ ln({_sql_far_gap(z)}) ELSE ln({z} * {sql_cdf(z)} + {sql_pdf(z)}) END)")


def _lit(v: float) -> str:
    return f"{v!r}::DOUBLE"


def sql_erf(x: str) -> str:
    a1, a2, a3, a4, a5 = AS_A
    t = f"({_lit(1.0)} / ({_lit(1.0)} + {_lit(AS_P)} * abs({x})))"
    poly = (f"{t} * ({_lit(a1)} + {t} * ({_lit(a2)} + {t} * ({_lit(a3)} + {t} * ({_lit(a4)} + {t} * "
            f"{_lit(a5)}))))")
    y = f"({_lit(1.0)} - {poly} * exp(-(abs({x}) * abs({x}))))"
    return f"(CASE WHEN {x} < 0 THEN -{y} ELSE {y} END)"


def sql_cdf(z: str) -> str:
    return f"({_lit(0.5)} * ({_lit(1.0)} + {sql_erf(f'(({z}) / {_lit(SQRT2)})')}))"


def sql_pdf(z: str) -> str:
    return f"({_lit(INV_SQRT_2PI)} * exp({_lit(-0.5)} * ({z}) * ({z})))"


def norm_ppf(p: float) -> float:
    """Inverse normal cdf on the driver (for scalar parameters such as a coverage level)."""
    if not 0.0 < p < 1.0:
        raise ValueError("p must be in (0, 1)")
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if 0.5 * math.erfc(-mid / SQRT2) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def erfc(x: Column) -> Column:
    """Complementary error function (A&S 7.1.26 form, absolute error <= 1.5e-7)."""
    ax = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(AS_P) * ax)
    a1, a2, a3, a4, a5 = AS_A
    poly = t * (F.lit(a1) + t * (F.lit(a2) + t * (F.lit(a3) + t * (F.lit(a4) + t * F.lit(a5)))))
    pos = poly * F.exp(-(ax * ax))
    return F.when(x < 0, F.lit(2.0) - pos).otherwise(pos)


def sql_erfc(x: str) -> str:
    a1, a2, a3, a4, a5 = AS_A
    t = f"({_lit(1.0)} / ({_lit(1.0)} + {_lit(AS_P)} * abs({x})))"
    poly = (f"{t} * ({_lit(a1)} + {t} * ({_lit(a2)} + {t} * ({_lit(a3)} + {t} * ({_lit(a4)} + {t} * "
            f"{_lit(a5)}))))")
    pos = f"({poly} * exp(-(abs({x}) * abs({x}))))"
    return f"(CASE WHEN {x} < 0 THEN {_lit(2.0)} - {pos} ELSE {pos} END)"


def two_sided_normal_p(z: Column) -> Column:
    """P(|Z| >= |z|) = erfc(|z| / sqrt(2)), capped at 1."""
    return F.least(F.lit(1.0), erfc(F.abs(z) / F.lit(SQRT2)))


def sql_two_sided_normal_p(z: str) -> str:
    return f"least({_lit(1.0)}, {sql_erfc(f'(abs({z}) / {_lit(SQRT2)})')})"
