"""Kernel and distance expressions over ``ARRAY<DOUBLE>`` columns, with DuckDB twins.

Reductions are left-to-right ``aggregate`` folds; the SQL twins use ``list_sum``
over the same element order, so both engines add the same terms in the same order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TANIMOTO_EPS = 1e-6
SQRT3 = math.sqrt(3.0)
SQRT5 = math.sqrt(5.0)


def _fold_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def sqdist(a: Column, b: Column) -> Column:
    return _fold_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def dot(a: Column, b: Column) -> Column:
    return _fold_sum(F.zip_with(a, b, lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(sqdist(a, b))


def jaccard_distance(a: Column, b: Column) -> Column:
    """(# coordinates that differ and are not both 0) / (# not both 0); both all-zero -> 0."""
    nz = F.aggregate(F.zip_with(a, b, lambda x, y: F.when((x != 0) | (y != 0), 1).otherwise(0)), F.lit(0),
                     lambda acc, v: acc + v)
    df = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(((x != 0) | (y != 0)) & (x != y), 1).otherwise(0)),
                     F.lit(0), lambda acc, v: acc + v)
    return F.when(nz == 0, F.lit(0.0)).otherwise(df.cast("double") / nz.cast("double"))


def matern(r: Column, nu: float) -> Column:
    if nu == 0.5:
        return F.exp(-r)
    if nu == 1.5:
        return (F.lit(1.0) + F.lit(SQRT3) * r) * F.exp(F.lit(-SQRT3) * r)
    if nu == 2.5:
        return (F.lit(1.0) + F.lit(SQRT5) * r + F.lit(5.0 / 3.0) * r * r) * F.exp(F.lit(-SQRT5) * r)
    raise ValueError("nu must be 0.5, 1.5 or 2.5")


def rq(r: Column, alpha: float) -> Column:
    return F.pow(F.lit(1.0) + r * r / F.lit(2.0 * alpha), F.lit(-alpha))


def kernel_value(name: str, a: Column, b: Column, lengthscale: float = 0.5, outputscale: float = 2.0,
                 alpha: float = 1.0, variance: float = 1.0) -> Column:
    """Scaled kernel k(a, b) by name: linear, tanimoto, matern05, matern15, matern25, rq, or 'k1+k2'."""
    if "+" in name:
        parts = [kernel_value(p.strip(), a, b, lengthscale, outputscale, alpha, variance) for p in name.split("+")]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out
    if name == "linear":
        return F.lit(variance) * dot(a, b)
    if name == "tanimoto":
        ab = dot(a, b)
        sim = (ab + F.lit(TANIMOTO_EPS)) / (F.lit(TANIMOTO_EPS) + dot(a, a) + dot(b, b) - ab)
        return F.lit(outputscale) * F.greatest(sim, F.lit(0.0))
    r = F.sqrt(sqdist(a, b)) / F.lit(lengthscale)
    base = {"matern05": lambda: matern(r, 0.5), "matern15": lambda: matern(r, 1.5),
            "matern25": lambda: matern(r, 2.5), "rq": lambda: rq(r, alpha)}
    if name not in base:
        raise ValueError(f"unknown kernel '{name}'; choose linear, tanimoto, matern05, matern15, matern25, rq")
    return F.lit(outputscale) * base[name]()


# ---- SQL twins -----------------------------------------------------------
def _d(v: float) -> str:
    return f"{v!r}::DOUBLE"


def sql_sqdist(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def sql_kernel(name: str, a: str, b: str, lengthscale: float = 0.5, outputscale: float = 2.0,
               alpha: float = 1.0, variance: float = 1.0) -> str:
    if "+" in name:
        parts = [sql_kernel(p.strip(), a, b, lengthscale, outputscale, alpha, variance) for p in name.split("+")]
        out = parts[0]
        for p in parts[1:]:
            out = f"({out} + {p})"
        return out
    if name == "linear":
        return f"({_d(variance)} * {sql_dot(a, b)})"
    if name == "tanimoto":
        ab, e = sql_dot(a, b), _d(TANIMOTO_EPS)
        return f"({_d(outputscale)} * greatest(({ab} + {e}) / ({e} + {sql_dot(a, a)} + {sql_dot(b, b)} - {ab}), {_d(0.0)}))"
    r = f"(sqrt({sql_sqdist(a, b)}) / {_d(lengthscale)})"
    if name == "matern05":
        k = f"exp(-{r})"
    elif name == "matern15":
        k = f"(({_d(1.0)} + {_d(SQRT3)} * {r}) * exp({_d(-SQRT3)} * {r}))"
    elif name == "matern25":
        k = f"(({_d(1.0)} + {_d(SQRT5)} * {r} + {_d(5.0 / 3.0)} * {r} * {r}) * exp({_d(-SQRT5)} * {r}))"
    elif name == "rq":
        k = f"pow({_d(1.0)} + {r} * {r} / {_d(2.0 * alpha)}, {_d(-alpha)})"
    else:
        raise ValueError(name)
    return f"({_d(outputscale)} * {k})"


def np_kernel(name: str, xa, xb, lengthscale: float = 0.5, outputscale: float = 2.0, alpha: float = 1.0,
              variance: float = 1.0):
    """numpy form (n x d, m x d) -> n x m, used inside Arrow batches and on the driver."""
    import numpy as np

    if "+" in name:
        return sum(np_kernel(p.strip(), xa, xb, lengthscale, outputscale, alpha, variance) for p in name.split("+"))
    if name == "linear":
        return variance * xa @ xb.T
    if name == "tanimoto":
        ab = xa @ xb.T
        norms = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None, :]
        return outputscale * np.maximum((ab + TANIMOTO_EPS) / (TANIMOTO_EPS + norms - ab), 0.0)
    r = (xa * xa).sum(1)[:, None] + (xb * xb).sum(1)[None, :]
    r -= 2.0 * xa @ xb.T
    np.sqrt(np.maximum(r, 0.0, out=r), out=r)
    r /= lengthscale
    if name == "matern05":
        k = np.exp(-r)
    elif name == "matern15":
        k = (1.0 + SQRT3 * r) * np.exp(-SQRT3 * r)
    elif name == "matern25":
        t = SQRT5 * r
        k = 1.0 + t
        r *= 5.0 / 3.0 * r
        k += r
        k *= np.exp(np.negative(t, out=t), out=t)
    elif name == "rq":
        k = (1.0 + r * r / (2.0 * alpha)) ** (-alpha)
    else:
        raise ValueError(name)
    k *= outputscale
    return k
