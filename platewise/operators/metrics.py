"""Metrics on predictions and targets.

Everything is one grouped aggregate (partial, map-side combined) over the
prediction table; order statistics use the distributed ``global_rank`` instead of
a single-partition window or a driver-side sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.moments import stddev_samp, var_pop, var_samp
from platewise.functions.normal import norm_ppf
from platewise.operators.ordered import global_rank

LN_2PI = math.log(2.0 * math.pi)


def _sst(y: str) -> Column:
    return var_pop(y) * F.count(y)


# ------------------------------------------------------------------ H1
def regression_scores(df: DataFrame, y: str = "y", mu: str = "mu", by: Sequence[str] = ()) -> DataFrame:
    """H1: MSE, MAE and R^2 (= 1 - SSE/SST, null when SST = 0) per group."""
    err = F.col(y) - F.col(mu)
    sse = F.sum(err * err)
    return df.groupBy(*by).agg(
        F.count(y).alias("n"), F.avg(err * err).alias("mse"), F.avg(F.abs(err)).alias("mae"),
        F.when(_sst(y) == 0, F.lit(None)).otherwise(F.lit(1.0) - sse / _sst(y)).alias("r2"))


# ------------------------------------------------------------------ H2 / H3
def nlpd(df: DataFrame, y: str = "y", mu: str = "mu", var: str = "var", by: Sequence[str] = ()) -> DataFrame:
    """H2 (diagonal form): mean of 0.5*ln(2*pi*var) + (y-mu)^2/(2*var)."""
    e = F.col(y) - F.col(mu)
    term = F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * F.col(var)) + e * e / (F.lit(2.0) * F.col(var))
    return df.groupBy(*by).agg(F.avg(term).alias("nlpd"))


def msll(df: DataFrame, y: str = "y", mu: str = "mu", var: str = "var", by: Sequence[str] = (),
         standard: bool = False) -> DataFrame:
    """H3: the reference's log-loss, 0.5 * mean(ln(2*pi*var) + (y-mu)^2/(2*var)).

    ``standard=True`` gives 0.5*ln(2*pi*var) + (y-mu)^2/(2*var) instead.
    """
    e = F.col(y) - F.col(mu)
    inner = F.log(F.lit(2.0 * math.pi) * F.col(var)) + e * e / (F.lit(2.0) * F.col(var))
    term = (F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * F.col(var)) + e * e / (F.lit(2.0) * F.col(var))
            if standard else F.lit(0.5) * inner)
    return df.groupBy(*by).agg(F.avg(term).alias("msll"))


# ------------------------------------------------------------------ H4
def qce(df: DataFrame, y: str = "y", mu: str = "mu", var: str = "var", by: Sequence[str] = (),
        quantile: float = 95.0) -> DataFrame:
    """H4: |share of y strictly inside mu +- z*sd - quantile/100|."""
    if quantile <= 0 or quantile >= 100:
        raise ValueError("quantile must be between 0 and 100")
    z = norm_ppf(0.5 + 0.5 * quantile / 100.0)
    sd = F.sqrt(F.col(var))
    inside = (F.col(y) > F.col(mu) - F.lit(z) * sd) & (F.col(y) < F.col(mu) + F.lit(z) * sd)
    return df.groupBy(*by).agg(F.abs(F.avg(inside.cast("double")) - F.lit(quantile / 100.0)).alias("qce"))


# ------------------------------------------------------------------ H5
def tail_scores(df: DataFrame, id_cols: Sequence[str], y: str = "y", mu: str = "mu", var: str = "var",
                share: float = 0.05) -> DataFrame:
    """H5: NLPD, R^2, MAE on the top share, bottom share and all rows by true y.

    k = floor(share * n); ascending by (y, ids); top = last k, bottom = first k
    (k = 0 gives empty subsets). Ranks come from ``global_rank`` (distributed).
    """
    n = df.count()
    k = int(math.floor(share * n))
    ranked = global_rank(df, [y, *id_cols])
    subsets = F.array(
        F.lit("all"),
        F.when(F.col("rank") < k, F.lit("bottom_5")),
        F.when(F.col("rank") >= n - k, F.lit("top_5")))
    tagged = ranked.withColumn("subset", F.explode(F.filter(subsets, lambda s: s.isNotNull())))
    e = F.col(y) - F.col(mu)
    term = F.lit(0.5) * F.log(F.lit(2.0 * math.pi) * F.col(var)) + e * e / (F.lit(2.0) * F.col(var))
    return tagged.groupBy("subset").agg(
        F.count(F.lit(1)).alias("n"), F.avg(term).alias("nlpd"), F.avg(F.abs(e)).alias("mae"),
        F.when(_sst(y) == 0, F.lit(None)).otherwise(F.lit(1.0) - F.sum(e * e) / _sst(y)).alias("r2"))


# ------------------------------------------------------------------ H6
def target_stats(df: DataFrame, y: str = "y", features: str | None = "features") -> DataFrame:
    """H6: max, mean, sample sd, sample variance, feature dimension and count of the target."""
    aggs = [F.max(y).alias("target_stat_max"), F.avg(y).alias("target_stat_mean"),
            stddev_samp(y).alias("target_stat_std"), var_samp(y).alias("target_stat_var"),
            F.count(y).alias("input_stat_n_points")]
    if features:
        aggs.append(F.max(F.size(features)).cast("bigint").alias("input_stat_feature_dimension"))
    return df.agg(*aggs)


# ------------------------------------------------------------------ H7
def target_quantiles(df: DataFrame, y: str, qs: Sequence[float] = (0.75, 0.9, 0.95, 0.99),
                     id_cols: Sequence[str] = ()) -> DataFrame:
    """H7: exact quantiles with linear interpolation, one row per q.

    Only the order statistics at floor/ceil of q*(n-1) are fetched, located with
    ``global_rank``; no group of values is ever held by one task.
    """
    vals = df.filter(F.col(y).isNotNull() & ~F.isnan(y))
    n = vals.count()
    if n == 0:
        spark = df.sparkSession
        return spark.createDataFrame([(float(q), None) for q in qs], "q double, value double")
    ranked = global_rank(vals.select(y, *id_cols), [y, *id_cols])
    want = {}
    for q in qs:
        pos = q * (n - 1)
        want[q] = (pos, math.floor(pos), math.ceil(pos))
    idx = sorted({i for _, lo, hi in want.values() for i in (lo, hi)})
    picked = ranked.filter(F.col("rank").isin(idx)).select("rank", y)
    qdf = df.sparkSession.createDataFrame([(float(q), float(p), int(lo), int(hi)) for q, (p, lo, hi) in want.items()],
                                          "q double, pos double, lo bigint, hi bigint")
    lo_v = picked.select(F.col("rank").alias("lo"), F.col(y).alias("x_lo"))
    hi_v = picked.select(F.col("rank").alias("hi"), F.col(y).alias("x_hi"))
    j = qdf.join(F.broadcast(lo_v), "lo").join(F.broadcast(hi_v), "hi")
    val = F.when(F.col("lo") == F.col("hi"), F.col("x_lo")).otherwise(
        (F.col("hi") - F.col("pos")) * F.col("x_lo") + (F.col("pos") - F.col("lo")) * F.col("x_hi"))
    return j.select("q", val.alias("value"))


# ------------------------------------------------------------------ H8
def top_n_thresholds(df: DataFrame, y: str, ns: Sequence[int] = (1, 3, 5, 10)) -> DataFrame:
    """H8: the n-th largest value for each n (duplicates counted): a bounded top-k."""
    k = max(ns)
    top = df.filter(F.col(y).isNotNull()).select(y).orderBy(F.col(y).desc()).limit(k)
    from pyspark.sql import Window
    ranked = top.withColumn("pos", F.row_number().over(Window.orderBy(F.col(y).desc())))
    return ranked.filter(F.col("pos").isin(list(ns))).select(F.col("pos").cast("bigint").alias("n"),
                                                             F.col(y).alias("threshold"))


# ------------------------------------------------------------------ H9 / H10
def count_at_or_above(train: DataFrame, thresholds: DataFrame, y: str, key: str = "n") -> DataFrame:
    """Number of train values >= each threshold (thresholds are few: broadcast)."""
    th = [(r[key], r["threshold"]) for r in thresholds.collect()]
    aggs = [F.sum(F.when(F.col(y) >= F.lit(t), 1).otherwise(0)).cast("bigint").alias(f"c{i}")
            for i, (_, t) in enumerate(th)]
    row = train.agg(*aggs) if aggs else None
    spark = train.sparkSession
    if row is None:
        return spark.createDataFrame([], f"{key} double, threshold double, count bigint")
    stacked = F.explode(F.array(*[F.struct(F.lit(k).alias(key), F.lit(t).alias("threshold"),
                                           F.col(f"c{i}").alias("count")) for i, (k, t) in enumerate(th)]))
    return row.select(stacked.alias("s")).select(f"s.{key}", "s.threshold", "s.count")


# ------------------------------------------------------------------ H11
def residuals(df: DataFrame, y: str = "y", mu: str = "mu") -> DataFrame:
    """Predicted minus actual, per row."""
    return df.withColumn("residual", F.col(mu) - F.col(y))
