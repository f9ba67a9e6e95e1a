"""Acquisition functions and batch selection.

Acquisitions are Column expressions over (mu, var): they run inside whole-stage
codegen on every candidate with no shuffle. Sample-based acquisitions reduce
analytically where the sample average is linear (qUCB), or carry their small,
parameter-sized draw set as a literal array (NEI).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.normal import ei_core, log_ei_core
from platewise.functions.rand import md5_u32

MIN_VAR = 1e-12


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ------------------------------------------------------------------ G4
def ucb(mu: Column | str, var: Column | str, beta: float = 0.1) -> Column:
    """Mu + sqrt(beta * var)."""
    return _c(mu) + F.sqrt(F.lit(beta) * _c(var))


# ------------------------------------------------------------------ G5
def ei(mu: Column | str, var: Column | str, best_f: Column | float) -> Column:
    """S * (z * Phi(z) + phi(z)), z = (mu - best_f) / s, s = sqrt(max(var, 1e-12))."""
    s = F.sqrt(F.greatest(_c(var), F.lit(MIN_VAR)))
    b = best_f if isinstance(best_f, Column) else F.lit(float(best_f))
    z = (_c(mu) - b) / s
    return s * ei_core(z)


def log_ei(mu: Column | str, var: Column | str, best_f: Column | float) -> Column:
    """ln of G5, which still ranks candidates whose improvement underflows."""
    s = F.sqrt(F.greatest(_c(var), F.lit(MIN_VAR)))
    b = best_f if isinstance(best_f, Column) else F.lit(float(best_f))
    return F.log(s) + log_ei_core((_c(mu) - b) / s)


# ------------------------------------------------------------------ G7
def halton(i: Column, base: int, digits: int) -> Column:
    """Radical inverse of integer i in ``base`` (a low-discrepancy draw in (0, 1))."""
    terms = [F.pmod(F.floor(i / F.lit(base ** k)), F.lit(base)) * F.lit(base ** -(k + 1))
             for k in range(digits)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def qmc_normal_draws(spark, n: int = 1024) -> DataFrame:
    """n quasi-random standard normal draws (Box-Muller on Halton bases 2 and 3)."""
    i = F.col("id") + F.lit(1)
    u1 = halton(i, 2, 16)
    u2 = halton(i, 3, 11)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return spark.range(n).select(F.col("id").alias("draw"), z.alias("z"))


def qucb(mu: Column | str, var: Column | str, mean_abs_z: Column | float, beta: float = 0.1) -> Column:
    """Batch UCB by sampling, q = 1: mean over draws of mu + sqrt(beta*pi/2)*|z|*s.

    The sample mean is linear in |z|, so it equals mu + sqrt(beta*pi/2)*s*mean|z|;
    one scalar over the draw table replaces a candidates x draws expansion.
    """
    m = mean_abs_z if isinstance(mean_abs_z, Column) else F.lit(float(mean_abs_z))
    return _c(mu) + F.lit(math.sqrt(beta * math.pi / 2.0)) * F.sqrt(_c(var)) * m


# ------------------------------------------------------------------ G6
def nei(mu: Column | str, var: Column | str, best_draws: Sequence[float]) -> Column:
    """EI averaged over draws of the best noisy observed value.

    ``best_draws`` holds one best value per draw (parameter-sized, e.g. 100); it is
    a literal array, so every candidate folds over it inside its own task.
    """
    arr = F.array(*[F.lit(float(b)) for b in best_draws])
    s = F.sqrt(F.greatest(_c(var), F.lit(MIN_VAR)))
    total = F.aggregate(arr, F.lit(0.0), lambda acc, b: acc + s * (
        ei_core((_c(mu) - b) / s)))
    return total / F.lit(float(len(best_draws)))


def noisy_best_draws(train_y: Sequence[float], noise_sd: Sequence[float] | float, n: int = 100,
                     seed: int = 0) -> list[float]:
    """Best observed value under n draws of observation noise (driver side, train-sized)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    y = np.asarray(train_y, dtype=float)
    sd = np.broadcast_to(np.asarray(noise_sd, dtype=float), y.shape)
    draws = y[None, :] + sd[None, :] * rng.standard_normal((n, y.size))
    return draws.max(axis=1).tolist()


# ------------------------------------------------------------------ G8
def random_pick(df: DataFrame, id_col: str, b: int, seed: int = 0) -> DataFrame:
    """B random candidates: the b smallest md5(seed:id) draws (top-k, no full sort)."""
    key = md5_u32(F.lit(str(seed)), F.col(id_col))
    return df.withColumn("__r", key).orderBy("__r", id_col).limit(b).drop("__r")


# ------------------------------------------------------------------ G9
def select_batch(df: DataFrame, id_cols: Sequence[str], acq_col: str, b: int = 1) -> DataFrame:
    """The b highest acquisition values (ties -> lowest id), plus the sum of all
    values and the top id. The top-b is a bounded TakeOrdered; the sum a partial aggregate."""
    order = [F.col(acq_col).desc()] + [F.col(c) for c in id_cols]
    top = df.select(*id_cols, acq_col).orderBy(*order).limit(b)
    top = top.withColumn("pick", F.row_number().over(Window.orderBy(*order)))
    total = df.agg(F.sum(acq_col).alias("sum_acq")).first()["sum_acq"]
    return top.withColumn("sum_acq", F.lit(total).cast("double"))


# ------------------------------------------------------------------ G10
def move_observed(status: DataFrame, ids: DataFrame, id_col: str, status_col: str = "status") -> DataFrame:
    """Picked rows leave held-out and join train (one narrow pass + a semi-join flag)."""
    picked = ids.select(F.col(id_col).alias("__pid"), F.lit(True).alias("__picked"))
    j = status.join(picked, F.col(id_col) == F.col("__pid"), "left")
    return j.withColumn(status_col, F.when(F.col("__picked"), F.lit("train")).otherwise(F.col(status_col))) \
        .drop("__pid", "__picked")


# ------------------------------------------------------------------ G12
def sweep_grid(spark, params: Mapping[str, Sequence], seeds: Sequence[int]) -> DataFrame:
    """Every combination of configuration values x seeds (parameter-sized).

    Built by exploding literal arrays, so the grid is generated inside one
    narrow stage; its size is the product of the (small) value lists.
    """
    df = spark.range(1).select(F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"))
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
