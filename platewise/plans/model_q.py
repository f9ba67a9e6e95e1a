"""Catalogue entries for metrics (H1-H11), acquisitions (G4-G10, G12) and scaling."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from platewise.functions.normal import norm_ppf, sql_ei_core, sql_log_ei_core
from platewise.functions.rand import sql_md5_u32
from platewise.operators import acquire as G
from platewise.operators import metrics as H
from platewise.operators import scale as D
from platewise.plans.registry import register, rounded, sql_percentile
from platewise.sources import fixtures as FX
from platewise.sources.tables import table

PRED = FX.with_sql(FX.SQL_PRED)
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS_SQL = ", ".join(KEYS)


def _pi_lit() -> str:
    return f"{2.0 * math.pi!r}::DOUBLE"


LN_TERM = (f"(0.5::DOUBLE * ln({_pi_lit()} * var) + (y - mu) * (y - mu) / (2.0::DOUBLE * var))")


# ---------------------------------------------------------------- H1
@register("regression_scores", rounded(PRED + """
SELECT split, count(y) AS n, avg((y - mu) * (y - mu)) AS mse, avg(abs(y - mu)) AS mae,
       CASE WHEN var_pop(y) * count(y) = 0 THEN NULL
            ELSE 1.0::DOUBLE - sum((y - mu) * (y - mu)) / (var_pop(y) * count(y)) END AS r2
FROM pred GROUP BY split""", ["mse", "mae", "r2"]))
def q_regression_scores(spark, d):
    return H.regression_scores(FX.pred(spark, d), by=["split"])


# ---------------------------------------------------------------- H2 / H3 / H4
@register("nlpd", rounded(PRED + f"SELECT split, avg({LN_TERM}) AS nlpd FROM pred GROUP BY split", ["nlpd"]))
def q_nlpd(spark, d):
    return H.nlpd(FX.pred(spark, d), by=["split"])


@register("msll", rounded(PRED + f"""
SELECT split, avg(0.5::DOUBLE * (ln({_pi_lit()} * var) + (y - mu) * (y - mu) / (2.0::DOUBLE * var))) AS msll
FROM pred GROUP BY split""", ["msll"]))
def q_msll(spark, d):
    return H.msll(FX.pred(spark, d), by=["split"])


Z95 = norm_ppf(0.975)


@register("qce", rounded(PRED + f"""
SELECT split, abs(avg(CASE WHEN y > mu - {Z95!r}::DOUBLE * sqrt(var) AND y < mu + {Z95!r}::DOUBLE * sqrt(var)
                          THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - 0.95::DOUBLE) AS qce
FROM pred GROUP BY split""", ["qce"]))
def q_qce(spark, d):
    return H.qce(FX.pred(spark, d), by=["split"], quantile=95.0)


# ---------------------------------------------------------------- H5
@register("tail_scores", rounded(PRED + f"""
, r AS (SELECT *, row_number() OVER (ORDER BY y, {KEYS_SQL}) - 1 AS rk, count(*) OVER () AS n_all FROM pred),
t AS (SELECT 'all' AS subset, * FROM r
      UNION ALL SELECT 'bottom_5', * FROM r WHERE rk < floor(0.05 * n_all)
      UNION ALL SELECT 'top_5', * FROM r WHERE rk >= n_all - floor(0.05 * n_all))
SELECT subset, count(*) AS n, avg({LN_TERM}) AS nlpd, avg(abs(y - mu)) AS mae,
       CASE WHEN var_pop(y) * count(y) = 0 THEN NULL
            ELSE 1.0::DOUBLE - sum((y - mu) * (y - mu)) / (var_pop(y) * count(y)) END AS r2
FROM t GROUP BY subset""".replace("\n, r AS", ", r AS"), ["nlpd", "mae", "r2"]))
def q_tail_scores(spark, d):
    return H.tail_scores(FX.pred(spark, d), KEYS)


# ---------------------------------------------------------------- H6
@register("target_stats", rounded(FX.with_sql(FX.SQL_VEC) + """
SELECT max(y) AS target_stat_max, avg(y) AS target_stat_mean, stddev_samp(y) AS target_stat_std,
       var_samp(y) AS target_stat_var, count(y) AS input_stat_n_points,
       max(len(features))::BIGINT AS input_stat_feature_dimension FROM vec""",
                                  ["target_stat_max", "target_stat_mean", "target_stat_std", "target_stat_var"]))
def q_target_stats(spark, d):
    return H.target_stats(FX.vec(spark, d), "y", "features")


# ---------------------------------------------------------------- H7 / H8 / H9 / H10
QS = (0.75, 0.9, 0.95, 0.99)
CAND = FX.with_sql(FX.SQL_CAND)
QUANT_SQL = "quants AS (" + " UNION ALL ".join(
    f"SELECT {q!r}::DOUBLE AS q, {sql_percentile('objective', q)} AS value FROM cand" for q in QS) + ")"
TOPN_SQL = """topn AS (SELECT pos::INTEGER AS n, objective AS threshold FROM (
  SELECT objective, row_number() OVER (ORDER BY objective DESC) AS pos FROM cand WHERE objective IS NOT NULL)
  WHERE pos IN (1, 3, 5, 10))"""


@register("target_quantiles", rounded(CAND + ", " + QUANT_SQL + " SELECT q, value FROM quants", ["q", "value"]))
def q_target_quantiles(spark, d):
    return H.target_quantiles(FX.cand(spark, d), "objective", QS, ["candidate_id"])


@register("top_n_thresholds", rounded(CAND + ", " + TOPN_SQL + " SELECT n::BIGINT AS n, threshold FROM topn",
                                      ["threshold"]))
def q_top_n_thresholds(spark, d):
    return H.top_n_thresholds(FX.cand(spark, d), "objective")


def _train(spark, d):
    return FX.cand(spark, d).filter(F.col("p_size") < 10)


@register("top_n_counts", rounded(CAND + ", " + TOPN_SQL + """
SELECT t.n, t.threshold, (SELECT count(*) FROM cand c WHERE c.p_size < 10 AND c.objective >= t.threshold) AS count
FROM topn t""", ["threshold"]))
def q_top_n_counts(spark, d):
    th = H.top_n_thresholds(FX.cand(spark, d), "objective").withColumn("n", F.col("n").cast("int"))
    return H.count_at_or_above(_train(spark, d), th, "objective", key="n")


@register("quantile_counts", rounded(CAND + ", " + QUANT_SQL + """
SELECT t.q, t.value AS threshold,
       (SELECT count(*) FROM cand c WHERE c.p_size < 10 AND c.objective >= t.value) AS count
FROM quants t""", ["q", "threshold"]))
def q_quantile_counts(spark, d):
    th = H.target_quantiles(FX.cand(spark, d), "objective", QS, ["candidate_id"]) \
        .withColumnRenamed("value", "threshold")
    return H.count_at_or_above(_train(spark, d), th, "objective", key="q")


# ---------------------------------------------------------------- H11
@register("residuals", rounded(PRED + f"SELECT {KEYS_SQL}, mu - y AS residual FROM pred", ["residual"]))
def q_residuals(spark, d):
    return H.residuals(FX.pred(spark, d)).select(*KEYS, "residual")


# ---------------------------------------------------------------- G4 / G5 / G7
@register("acq_ucb", rounded(PRED + f"SELECT {KEYS_SQL}, mu + sqrt(0.1::DOUBLE * var) AS acq FROM pred", ["acq"]))
def q_acq_ucb(spark, d):
    p = FX.pred(spark, d)
    return p.select(*KEYS, G.ucb("mu", "var", 0.1).alias("acq"))


def _sql_ei(mu: str, var: str, best: str) -> str:
    s = f"sqrt(greatest({var}, {G.MIN_VAR!r}::DOUBLE))"
    z = f"(({mu} - {best}) / {s})"
    return f"({s} * {sql_ei_core(z)})"


def _sql_log_ei(mu: str, var: str, best: str) -> str:
    s = f"sqrt(greatest({var}, {G.MIN_VAR!r}::DOUBLE))"
    return f"(ln({s}) + {sql_log_ei_core(f'(({mu} - {best}) / {s})')})"


@register("acq_ei", rounded(PRED + f"""
SELECT {KEYS_SQL}, {_sql_ei('mu', 'var', 'b.best')} AS acq, {_sql_log_ei('mu', 'var', 'b.top')} AS log_acq_of_max
FROM pred, (SELECT avg(y) AS best, max(y) AS top FROM pred) b""",
                            ["acq", "log_acq_of_max"]))
def q_acq_ei(spark, d):
    p = FX.pred(spark, d)
    best, top = p.agg(F.avg("y"), F.max("y")).first()
    return p.select(*KEYS, G.ei("mu", "var", best).alias("acq"), G.log_ei("mu", "var", top).alias("log_acq_of_max"))


def _sql_halton(i: str, base: int, digits: int) -> str:
    terms = [f"((floor({i} / {float(base ** k)!r}::DOUBLE)::BIGINT % {base}) * {base ** -(k + 1)!r}::DOUBLE)"
             for k in range(digits)]
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return out


def _sql_draws(n: int = 1024) -> str:
    u1 = _sql_halton("(id + 1)", 2, 16)
    u2 = _sql_halton("(id + 1)", 3, 11)
    return (f"draws AS (SELECT id AS draw, sqrt(-2.0::DOUBLE * ln({u1})) * cos({2.0 * math.pi!r}::DOUBLE * {u2}) AS z "
            f"FROM range(0, {n}) t(id))")


@register("acq_qucb", rounded(PRED + ", " + _sql_draws() + f"""
SELECT {KEYS_SQL}, mu + {math.sqrt(0.1 * math.pi / 2.0)!r}::DOUBLE * sqrt(var) * m.mz AS acq
FROM pred, (SELECT avg(abs(z)) AS mz FROM draws) m""", ["acq"]))
def q_acq_qucb(spark, d):
    p = FX.pred(spark, d)
    mz = G.qmc_normal_draws(spark, 1024).agg(F.avg(F.abs("z"))).first()[0]
    return p.select(*KEYS, G.qucb("mu", "var", mz, 0.1).alias("acq"))


# ---------------------------------------------------------------- G8 / G9 / G10
VEC = FX.with_sql(FX.SQL_VEC)


def _sql_md5_order(seed: int) -> str:
    return sql_md5_u32(f"'{seed}:' || candidate_id::VARCHAR")


@register("acq_random", VEC + f"""
SELECT candidate_id FROM vec ORDER BY {_sql_md5_order(3)}, candidate_id LIMIT 5""")
def q_acq_random(spark, d):
    return G.random_pick(FX.vec(spark, d), "candidate_id", 5, seed=3).select("candidate_id")


@register("select_batch", rounded(PRED + f"""
SELECT row_number() OVER (ORDER BY acq DESC, {KEYS_SQL}) AS pick, {KEYS_SQL}, acq,
       (SELECT sum(mu + sqrt(0.1::DOUBLE * var)) FROM pred) AS sum_acq
FROM (SELECT {KEYS_SQL}, mu + sqrt(0.1::DOUBLE * var) AS acq FROM pred
      ORDER BY acq DESC, {KEYS_SQL} LIMIT 4)""", ["acq", "sum_acq"]))
def q_select_batch(spark, d):
    p = FX.pred(spark, d).withColumn("acq", G.ucb("mu", "var", 0.1))
    return G.select_batch(p, KEYS, "acq", 4).withColumn("pick", F.col("pick").cast("bigint"))


@register("move_observed", VEC + f"""
, init AS (SELECT candidate_id FROM vec ORDER BY {_sql_md5_order(1)}, candidate_id LIMIT 10),
picks AS (SELECT candidate_id FROM vec WHERE candidate_id NOT IN (SELECT candidate_id FROM init)
          ORDER BY {_sql_md5_order(2)}, candidate_id LIMIT 3)
SELECT candidate_id, CASE WHEN candidate_id IN (SELECT candidate_id FROM init)
                            OR candidate_id IN (SELECT candidate_id FROM picks) THEN 'train' ELSE 'heldout' END AS status
FROM vec""".replace("\n, init AS", ", init AS"))
def q_move_observed(spark, d):
    v = FX.vec(spark, d).select("candidate_id")
    init = G.random_pick(v, "candidate_id", 10, seed=1)
    status = v.join(init.withColumn("__t", F.lit(1)), "candidate_id", "left").select(
        "candidate_id", F.when(F.col("__t").isNotNull(), "train").otherwise("heldout").alias("status"))
    picks = G.random_pick(status.filter(F.col("status") == "heldout"), "candidate_id", 3, seed=2)
    return G.move_observed(status, picks, "candidate_id")


# ---------------------------------------------------------------- G12
@register("sweep_grid", """
SELECT s.seed::INTEGER AS seed, r.representation, k.kernel, a.acquisition
FROM range(0, 20) s(seed),
     (SELECT DISTINCT c_mktsegment AS representation FROM customer) r,
     (SELECT DISTINCT o_orderpriority AS kernel FROM orders) k,
     (SELECT unnest(['ucb', 'ei']) AS acquisition) a""")
def q_sweep_grid(spark, d):
    from platewise.operators.features import category_levels

    reps = category_levels(table(spark, d, "customer"), "c_mktsegment", 1000)
    kerns = category_levels(table(spark, d, "orders"), "o_orderpriority", 1000)
    return G.sweep_grid(spark, {"representation": reps, "kernel": kerns, "acquisition": ["ucb", "ei"]},
                        list(range(20)))


# ---------------------------------------------------------------- D2
@register("train_test_split", CAND + f"""
SELECT candidate_id, CASE WHEN row_number() OVER (ORDER BY {_sql_md5_order(1)}, candidate_id) - 1
                              < ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM cand""")
def q_train_test_split(spark, d):
    return D.train_test_split(FX.cand(spark, d).select("candidate_id"), "candidate_id", 0.2, seed=1)


# ---------------------------------------------------------------- D1
D1_SQL = VEC + f""", sp AS (SELECT candidate_id, CASE WHEN row_number() OVER (ORDER BY {_sql_md5_order(1)}, candidate_id) - 1
                              < ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM vec),
long AS (SELECT candidate_id, generate_subscripts(features, 1) - 1 AS dim, unnest(features) AS v FROM vec),
st AS (SELECT dim, avg(v) AS m, CASE WHEN stddev_pop(v) = 0 OR stddev_pop(v) IS NULL THEN 1.0 ELSE stddev_pop(v) END AS s
       FROM long JOIN sp USING (candidate_id) WHERE split = 'train' GROUP BY dim)
SELECT candidate_id, dim, (v - m) / s AS value FROM long JOIN st USING (dim)"""


@register("standard_scale", rounded(D1_SQL, ["value"]))
def q_standard_scale(spark, d):
    v = FX.vec(spark, d)
    sp = D.train_test_split(v, "candidate_id", 0.2, seed=1)
    stats = D.fit_scale(sp.filter(F.col("split") == "train"))
    out = D.apply_scale(v, stats)
    return out.select("candidate_id", F.posexplode("features").alias("dim", "value")) \
        .withColumn("dim", F.col("dim").cast("bigint"))


# ---------------------------------------------------------------- D3 (rows check: eigenvector signs and
# MLlib's solver have no SQL twin)
@register("pca_project")
def q_pca_project(spark, d):
    out, kept = D.pca_project(FX.vec(spark, d), 10)
    return out.select("candidate_id", F.posexplode("pcs").alias("component", "value"),
                      F.lit(kept).alias("variance_kept"))


# ---------------------------------------------------------------- D4
@register("standardize_outcome", rounded(VEC + """
, long AS (SELECT candidate_id, y, generate_subscripts(features, 1) - 1 AS dim, unnest(features) AS v FROM vec),
st AS (SELECT dim, min(v) AS lo, max(v) - min(v) AS rg FROM long GROUP BY dim),
ys AS (SELECT avg(y) AS m, stddev_samp(y) AS s FROM vec)
SELECT candidate_id, (y - ys.m) / ys.s AS y_std, dim, CASE WHEN rg = 0 THEN 0.0 ELSE (v - lo) / rg END AS x01
FROM long JOIN st USING (dim), ys""".replace("\n, long AS", ", long AS"), ["y_std", "x01"]))
def q_standardize_outcome(spark, d):
    v = FX.vec(spark, d)
    v, m, s = D.standardize_outcome(v, "y", "y_std")
    v = D.normalize_inputs(v, "features", "x")
    return v.select("candidate_id", "y_std", F.posexplode("x").alias("dim", "x01")) \
        .withColumn("dim", F.col("dim").cast("bigint"))
