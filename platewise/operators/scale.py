"""Scaling, splitting and projection of feature vectors.

Per-dimension statistics are one ``posexplode`` + grouped aggregate (partial,
d output rows); the d-sized result is the only thing brought to the driver and
is applied back as literal arrays inside a single ``transform``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.moments import stddev_pop, stddev_samp
from platewise.functions.rand import md5_u32
from platewise.operators.ordered import global_rank


def dim_stats(df: DataFrame, features: str = "features") -> list[dict]:
    """Per-dimension count, mean, population and sample sd, min and max (d rows)."""
    long = df.select(F.posexplode(features).alias("dim", "v"))
    rows = (long.groupBy("dim").agg(F.avg("v").alias("mean"), stddev_pop("v").alias("sd_pop"),
                                    stddev_samp("v").alias("sd_samp"), F.min("v").alias("min"),
                                    F.max("v").alias("max"))
            .orderBy("dim").collect())
    return [r.asDict() for r in rows]


# ------------------------------------------------------------------ D1
def fit_scale(train: DataFrame, features: str = "features") -> dict:
    """D1 fit: mean and population sd per dimension (sd 0 -> 1)."""
    st = dim_stats(train, features)
    return {"mean": [s["mean"] for s in st],
            "scale": [(s["sd_pop"] or 1.0) for s in st]}


def apply_scale(df: DataFrame, stats: dict, features: str = "features", out_col: str | None = None) -> DataFrame:
    """D1 apply: (x - mean) / sd with the train statistics."""
    mean = F.array(*[F.lit(float(m)) for m in stats["mean"]])
    sc = F.array(*[F.lit(float(s)) for s in stats["scale"]])
    return df.withColumn(out_col or features,
                         F.transform(features, lambda v, i: (v - F.element_at(mean, i + 1)) / F.element_at(sc, i + 1)))


# ------------------------------------------------------------------ D2
def train_test_split(df: DataFrame, id_col: str, test: float = 0.2, seed: int = 1) -> DataFrame:
    """Seeded split with exactly ceil(n * test) test rows: the rows with the smallest
    md5(seed:id) draws (distributed global rank, ties by id)."""
    n = df.count()
    n_test = int(math.ceil(n * test))
    keyed = df.withColumn("__r", md5_u32(F.lit(str(seed)), F.col(id_col)))
    ranked = global_rank(keyed, ["__r", id_col])
    return ranked.withColumn("split", F.when(F.col("rank") < n_test, "test").otherwise("train")) \
        .drop("__r", "rank")


# ------------------------------------------------------------------ D3
def pca_project(df: DataFrame, c: int, features: str = "features", scale: bool = True,
                out_col: str = "pcs") -> tuple[DataFrame, float]:
    """D3: first c principal components (MLlib PCA, d x d covariance by tree aggregation),
    signs fixed so the largest-magnitude loading of each component is positive, plus
    the share of variance kept. ``scale=True`` standardises first; ``False`` keeps the
    reference's unscaled fit."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    import numpy as np

    d = df
    if scale:
        d = apply_scale(d, fit_scale(d, features), features, "__x")
    else:
        d = d.withColumn("__x", F.col(features))
    vec = d.withColumn("__v", array_to_vector("__x"))
    # PCA centres internally for the covariance; project centred data
    means = dim_stats(vec.select(F.col("__x").alias("f")), "f")
    centre = F.array(*[F.lit(float(s["mean"])) for s in means])
    vec = vec.withColumn("__c", array_to_vector(F.transform("__x", lambda v, i: v - F.element_at(centre, i + 1))))
    model = PCA(k=c, inputCol="__v", outputCol="__p").fit(vec)
    pc = model.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), range(c)])
    signs[signs == 0] = 1.0
    loadings = pc * signs
    kept = float(np.sum(model.explainedVariance.toArray()))
    cols = []
    for j in range(c):
        w = F.array(*[F.lit(float(x)) for x in loadings[:, j]])
        cols.append(F.aggregate(F.zip_with(vector_to_array("__c"), w, lambda a, b: a * b), F.lit(0.0),
                                lambda acc, x: acc + x))
    out = vec.withColumn(out_col, F.array(*cols)).drop("__x", "__v", "__c")
    return out, kept


# ------------------------------------------------------------------ D4
def standardize_outcome(df: DataFrame, y: str = "y", out_col: str = "y_std") -> tuple[DataFrame, float, float]:
    """Target to mean 0 and sample sd 1 (returns the two constants to map back)."""
    r = df.agg(F.avg(y).alias("m"), stddev_samp(y).alias("s")).first()
    m, s = float(r["m"]), float(r["s"] or 1.0)
    return df.withColumn(out_col, (F.col(y) - F.lit(m)) / F.lit(s)), m, s


def unstandardize(col: Column, m: float, s: float) -> Column:
    return col * F.lit(s) + F.lit(m)


def normalize_inputs(df: DataFrame, features: str = "features", out_col: str | None = None,
                     stats: list[dict] | None = None) -> DataFrame:
    """Inputs onto [0, 1] per dimension with the (train) min and max (range 0 -> 0)."""
    st = stats or dim_stats(df, features)
    lo = F.array(*[F.lit(float(s["min"])) for s in st])
    rg = F.array(*[F.lit(float(s["max"] - s["min"])) for s in st])
    return df.withColumn(out_col or features, F.transform(
        features, lambda v, i: F.when(F.element_at(rg, i + 1) == 0, F.lit(0.0))
        .otherwise((v - F.element_at(lo, i + 1)) / F.element_at(rg, i + 1))))
