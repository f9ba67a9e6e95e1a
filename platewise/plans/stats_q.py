"""Catalogue entries for statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from platewise.functions.normal import sql_two_sided_normal_p
from platewise.operators import stats as K
from platewise.plans.registry import register, rounded, sql_percentile, sql_resamples
from platewise.sources import fixtures as FX

RUNS = FX.with_sql(FX.SQL_RUNS)
HIST = FX.with_sql(FX.SQL_HIST)


def _pairwise_sql(keys: list[str], param: str, metric: str, src: str = "runs", order: str = "run_id",
                  where: str = "TRUE") -> tuple[str, list[str]]:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    part = f"PARTITION BY {k}" if keys else ""
    on_keys = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    on_keys = (on_keys + " AND ") if keys else ""
    pk_keys = " AND ".join(f"p.{c} = v.{c}" for c in keys)
    pk_keys = (pk_keys + " AND ") if keys else ""
    d2 = "2.0::DOUBLE"
    body = f""", d AS (SELECT {kc}{param}::VARCHAR AS lvl, {metric} AS x, {order} AS o FROM {src}
           WHERE {param} IS NOT NULL AND {metric} IS NOT NULL AND NOT isnan({metric}) AND {where}),
lv AS (SELECT {kc}lvl, row_number() OVER ({part} ORDER BY min(o), lvl) AS i FROM d GROUP BY {kc}lvl),
mom AS (SELECT {kc}lvl, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM d GROUP BY {kc}lvl),
lm AS (SELECT * FROM lv JOIN mom USING ({kc}lvl)),
pairs AS (SELECT {', '.join('a.' + c for c in keys) + (', ' if keys else '')}a.lvl AS level_a, b.lvl AS level_b,
                 a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.v AS va, b.v AS vb
          FROM lm a JOIN lm b ON {on_keys}a.i < b.i),
vc AS (SELECT {kc}lvl, x, count(*) AS c FROM d GROUP BY {kc}lvl, x),
pv AS (SELECT {', '.join('p.' + c for c in keys) + (', ' if keys else '')}p.level_a, p.level_b, v.x,
              sum(CASE WHEN v.lvl = p.level_a THEN c ELSE 0 END) AS ca,
              sum(CASE WHEN v.lvl = p.level_b THEN c ELSE 0 END) AS cb
       FROM pairs p JOIN vc v ON {pk_keys}v.lvl IN (p.level_a, p.level_b)
       GROUP BY {', '.join('p.' + c for c in keys) + (', ' if keys else '')}p.level_a, p.level_b, v.x),
rk AS (SELECT *, coalesce(sum(ca + cb) OVER (PARTITION BY {kc}level_a, level_b ORDER BY x
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM pv),
rs AS (SELECT {kc}level_a, level_b, sum(ca * (below + (ca + cb + 1) / {d2})) AS r_a,
              sum((ca + cb) * (ca + cb) * (ca + cb) - (ca + cb))::DOUBLE AS tie
       FROM rk GROUP BY {kc}level_a, level_b),
st AS (SELECT p.*, r.r_a, r.tie, p.na::DOUBLE AS fa, p.nb::DOUBLE AS fb,
              p.va / p.na AS sa, p.vb / p.nb AS sb FROM pairs p JOIN rs r USING ({kc}level_a, level_b)),
u0 AS (SELECT *, r_a - fa * (fa + 1.0::DOUBLE) / {d2} AS u1, fa + fb AS nn,
              sqrt(fa * fb / 12.0::DOUBLE * ((fa + fb + 1.0::DOUBLE) - tie / ((fa + fb) * (fa + fb - 1.0::DOUBLE)))) AS sigma
       FROM st),
u1 AS (SELECT *, (greatest(u1, fa * fb - u1) - fa * fb / {d2} - 0.5::DOUBLE) / sigma AS zz FROM u0)
SELECT {kc}level_a || ' vs ' || level_b AS comparison, level_a, level_b, na AS n_a, nb AS n_b, u1 AS u,
       CASE WHEN sigma > 0 THEN zz END AS z,
       CASE WHEN sigma > 0 THEN {sql_two_sided_normal_p('zz')} END AS p_mwu,
       (ma - mb) / sqrt(sa + sb) AS t,
       (sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)) AS df,
       {_sql_student_p('(ma - mb) / sqrt(sa + sb)', '((sa + sb) * (sa + sb) / (sa * sa / (na - 1) + sb * sb / (nb - 1)))')} AS p_ttest
FROM u1"""
    return body, ["u", "z", "p_mwu", "t", "df", "p_ttest"]


def _sql_student_p(t: str, df: str, steps: int = 400) -> str:
    """Two-sided Student p: with x = sqrt(df) tan(a) the density is c cos(a)^(df - 1), summed by Simpson's rule."""
    h = f"(atan(abs({t}) / sqrt({df})) / {steps})"
    w = f"CASE WHEN k = 0 OR k = {steps} THEN 1.0 WHEN k % 2 = 1 THEN 4.0 ELSE 2.0 END"
    area = f"{h} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda k: ({w})::DOUBLE * pow(cos(k * {h}), {df} - 1)))"
    return f"greatest(0.0::DOUBLE, 1 - 2 * {area} * exp(lgamma(({df} + 1) / 2) - lgamma({df} / 2)) / sqrt(pi()))"


def _select_from(body: str, cols: list[str], prefix: str = RUNS) -> str:
    """Turn the generated final SELECT into a CTE and project the wanted columns."""
    head, tail = body.rsplit("\nSELECT ", 1)
    return prefix + head + ",\n_all AS (SELECT " + tail + ")\nSELECT " + ", ".join(cols) + " FROM _all"


# ---------------------------------------------------------------- K1 / K2
ACQ_WHERE = "acquisition IN ('ucb', 'ei')"
_acq_body, _ = _pairwise_sql([], "acquisition", "valid_r2", where=ACQ_WHERE)


def _acq_pair(spark, d):
    runs = FX.runs(spark, d).filter(F.col("acquisition").isin("ucb", "ei"))
    return K.pairwise_levels(runs, "acquisition", "valid_r2", "run_id")


@register("mann_whitney", rounded(_select_from(_acq_body, ["comparison", "n_a", "n_b", "u", "z", "p_mwu"]),
                                  ["u", "z", "p_mwu"]))
def q_mann_whitney(spark, d):
    return _acq_pair(spark, d).select("comparison", "n_a", "n_b", "u", "z", "p_mwu")


@register("welch_t", rounded(_select_from(_acq_body, ["comparison", "n_a", "n_b", "t", "df", "p_ttest"]),
                             ["t", "df", "p_ttest"]))
def q_welch_t(spark, d):
    return _acq_pair(spark, d).select("comparison", "n_a", "n_b", "t", "df", "p_ttest")


# ---------------------------------------------------------------- K3 / K4 / K5
_k3_body, _k3_dbl = _pairwise_sql([], "kernel", "valid_r2")
PW_COLS = ["comparison", "level_a", "level_b", "n_a", "n_b", "u", "z", "p_mwu", "t", "df", "p_ttest"]


@register("pairwise_levels", rounded(_select_from(_k3_body, PW_COLS), _k3_dbl))
def q_pairwise_levels(spark, d):
    return K.pairwise_levels(FX.runs(spark, d), "kernel", "valid_r2", "run_id")


_k4_body, _k4_dbl = _pairwise_sql(["representation", "acquisition"], "kernel", "valid_r2")


@register("parameter_influence", rounded(_select_from(_k4_body, ["representation", "acquisition"] + PW_COLS),
                                         _k4_dbl))
def q_parameter_influence(spark, d):
    return K.pairwise_levels(FX.runs(spark, d), "kernel", "valid_r2", "run_id",
                             keys=["representation", "acquisition"])


# K5 keeps rows where either p-value is below alpha
@register("significant_only", rounded(_select_from(_k4_body, ["representation", "acquisition"] + PW_COLS)
                                      + " WHERE p_mwu < 0.05 OR p_ttest < 0.05", _k4_dbl))
def q_significant_only(spark, d):
    tests = K.pairwise_levels(FX.runs(spark, d), "kernel", "valid_r2", "run_id",
                              keys=["representation", "acquisition"], with_p=True)
    return K.significant_only(tests, 0.05)


# ---------------------------------------------------------------- K6 / K7
def _ks_sql(vc: str) -> str:
    """From value counts per replicate to D and its exact p: the share of lattice paths that reach
    D, diagonal by diagonal over all replicates (list element i + 1 holds the path at (i, k - i))."""
    return f"""vc AS ({vc}),
cs AS (SELECT rep, sum(ca) OVER w / sum(ca) OVER (PARTITION BY rep) AS fa, sum(cb) OVER w / sum(cb) OVER (PARTITION BY rep) AS fb,
              sum(ca) OVER (PARTITION BY rep) AS na, sum(cb) OVER (PARTITION BY rep) AS nb
       FROM vc WINDOW w AS (PARTITION BY rep ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT rep, max(abs(fa - fb)) AS d, max(na) AS n_a, max(nb) AS n_b FROM cs GROUP BY rep),
walk AS (
  SELECT rep, 0 AS k, least(n_a, n_b)::BIGINT AS m, greatest(n_a, n_b)::BIGINT AS n, round(d * n_a * n_b)::BIGINT AS edge,
         list_transform(range(0, least(n_a, n_b)::BIGINT + 1), lambda i: CASE WHEN i = 0 AND d <= 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS p
  FROM g
  UNION ALL
  SELECT rep, k + 1, m, n, edge, list_transform(range(0, m + 1), lambda i:
           CASE WHEN i > k + 1 OR k + 1 - i > n THEN p[i + 1] WHEN abs(i * n - (k + 1 - i) * m) >= edge THEN 1.0
                ELSE (i * coalesce(p[i], 0.0) + (k + 1 - i) * p[i + 1]) / (k + 1) END::DOUBLE)
  FROM walk WHERE k < m + n),
ks AS (SELECT rep, d, n_a, n_b, least(1.0::DOUBLE, p[m + 1]) AS p FROM g JOIN walk USING (rep) WHERE k = m + n)"""


HIST_LOOP = HIST.replace("WITH", "WITH RECURSIVE", 1)
ARMS = "arms AS (SELECT arm, suggestion AS x, event_id FROM hist WHERE suggestion IS NOT NULL AND arm IN (0, 1))"
COUNTS = "sum(CASE WHEN arm = 0 THEN 1 ELSE 0 END)::DOUBLE AS ca, sum(CASE WHEN arm = 1 THEN 1 ELSE 0 END)::DOUBLE AS cb"
KS_SQL = f"{HIST_LOOP}, {ARMS}, {_ks_sql(f'SELECT 0 AS rep, x, {COUNTS} FROM arms GROUP BY x')} SELECT d, n_a, n_b, p FROM ks"


@register("ks_two_sample", rounded(KS_SQL, ["d", "n_a", "n_b", "p"]))
def q_ks_two_sample(spark, d):
    h = FX.hist(spark, d)
    return K.ks_two_sample(h, "arm", "suggestion", 0, 1)


KS_BOOT_SQL = (f"{HIST_LOOP}, {ARMS}, {sql_resamples('arms', 'arm', 'x', 'event_id', 100)}, "
               f"{_ks_sql(f'SELECT rep, x, {COUNTS} FROM drawn GROUP BY rep, x')} "
               "SELECT avg(d) AS mean_d, avg(p) AS mean_p, count(*) AS reps FROM ks")


@register("ks_bootstrap", rounded(KS_BOOT_SQL, ["mean_d", "mean_p"]))
def q_ks_bootstrap(spark, d):
    h = FX.hist(spark, d)
    return K.ks_bootstrap(h, "arm", "suggestion", 0, 1, ["event_id"], n=100, seed=0)


# ---------------------------------------------------------------- K8
def _boot_sql(n: int = 1000) -> str:
    return RUNS + f""", base AS (SELECT representation, round(valid_r2 * 100000000)::BIGINT AS x, run_id FROM runs WHERE valid_r2 IS NOT NULL),
{sql_resamples('base', 'representation', 'x', 'run_id', n)},
rm AS (SELECT representation, rep, sum(x) / (count(*) * 100000000.0::DOUBLE) AS m FROM drawn GROUP BY representation, rep),
ci AS (SELECT representation, {sql_percentile('m', 0.025)} AS ci_lo, {sql_percentile('m', 0.975)} AS ci_hi
       FROM rm GROUP BY representation),
g AS (SELECT representation, avg(valid_r2) AS mean, count(valid_r2) AS n FROM runs WHERE valid_r2 IS NOT NULL GROUP BY representation)
SELECT g.representation, g.mean, g.n, ci.ci_lo, ci.ci_hi FROM g LEFT JOIN ci ON g.representation IS NOT DISTINCT FROM ci.representation"""


@register("bootstrap_ci", rounded(_boot_sql(), ["mean", "ci_lo", "ci_hi"]))
def q_bootstrap_ci(spark, d):
    r = FX.runs(spark, d).filter(F.col("valid_r2").isNotNull())
    return K.bootstrap_ci(r, ["representation"], "valid_r2", ["run_id"], n=1000, seed=0, scale=8)


# ---------------------------------------------------------------- K9 / K10
CAND = FX.with_sql(FX.SQL_CAND)


@register("histogram", rounded(CAND + """, s AS (SELECT min(objective) AS lo, max(objective) AS hi FROM cand),
b AS (SELECT least(floor((objective - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, lo, hi
      FROM cand, s WHERE objective IS NOT NULL)
SELECT bin, any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30) AS lo,
       any_value(lo) + (bin + 1) * ((any_value(hi) - any_value(lo)) / 30) AS hi, count(*) AS count
FROM b GROUP BY bin""", ["lo", "hi"]))
def q_histogram(spark, d):
    return K.histogram(FX.cand(spark, d), "objective", 30)


KDE_SQL = CAND + f""", s AS (SELECT min(objective) AS lo, max(objective) AS hi, stddev_samp(objective) AS sd,
                 count(objective) AS n FROM cand),
p AS (SELECT lo, (hi - lo) / 199 AS step, sd * pow(n, -0.2::DOUBLE) * 1.5::DOUBLE AS h, n FROM s),
vc AS (SELECT objective AS x, count(*) AS c FROM cand WHERE objective IS NOT NULL GROUP BY objective),
k AS (SELECT g.i AS point, sum(c * exp(-0.5::DOUBLE * ((p.lo + g.i * p.step - x) / p.h) * ((p.lo + g.i * p.step - x) / p.h))) AS ks
      FROM vc, p, range(0, 200) g(i) GROUP BY g.i)
SELECT point::INTEGER AS point, p.lo + point * p.step AS x,
       ks * (1.0::DOUBLE / (p.n * p.h * {math.sqrt(2.0 * math.pi)!r}::DOUBLE)) AS density FROM k, p"""


@register("kde_curve", rounded(KDE_SQL, ["x", "density"]))
def q_kde_curve(spark, d):
    return K.kde_curve(FX.cand(spark, d), "objective", 200, 1.5)


# ---------------------------------------------------------------- K11 / K12
@register("box_stats", rounded(RUNS + f""", q AS (
  SELECT kernel, avg(valid_r2) AS mean, count(valid_r2) AS n, {sql_percentile('valid_r2', 0.25)} AS q1,
         {sql_percentile('valid_r2', 0.5)} AS median, {sql_percentile('valid_r2', 0.75)} AS q3
  FROM runs WHERE valid_r2 IS NOT NULL GROUP BY kernel)
SELECT q.kernel, q.mean, q.n, q.q1, q.median, q.q3, min(r.valid_r2) AS whisker_lo, max(r.valid_r2) AS whisker_hi
FROM q JOIN runs r ON r.kernel IS NOT DISTINCT FROM q.kernel
WHERE r.valid_r2 >= q.q1 - 1.5::DOUBLE * (q.q3 - q.q1) AND r.valid_r2 <= q.q3 + 1.5::DOUBLE * (q.q3 - q.q1)
GROUP BY q.kernel, q.mean, q.n, q.q1, q.median, q.q3""",
                               ["mean", "q1", "median", "q3", "whisker_lo", "whisker_hi"]))
def q_box_stats(spark, d):
    return K.box_stats(FX.runs(spark, d), ["kernel"], "valid_r2")


@register("mean_sd_by_level", rounded(RUNS + """
SELECT metric, kernel, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM (
  UNPIVOT (SELECT kernel, valid_r2, target_stat_max FROM runs) ON valid_r2, target_stat_max
  INTO NAME metric VALUE value) WHERE value IS NOT NULL GROUP BY metric, kernel""", ["mean", "sd"]))
def q_mean_sd_by_level(spark, d):
    return K.mean_sd_by_level(FX.runs(spark, d), ["kernel"], ["valid_r2", "target_stat_max"])
