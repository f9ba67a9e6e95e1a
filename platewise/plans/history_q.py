"""Catalogue entries for run histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import history as H
from platewise.plans.registry import register, rounded, sql_percentile, sql_resamples
from platewise.sources import fixtures as FX

HIST = FX.with_sql(FX.SQL_HIST)
ORDER = ["ts", "event_id"]


def collapsed(spark, d):
    return H.collapse_history(FX.hist(spark, d), "run_id", ORDER, "epoch", FX.HIST_METRICS)


SQL_COLLAPSED = """filled AS (
  SELECT *, last_value(epoch IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ts, event_id
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_epoch
  FROM hist),
coll AS (
  SELECT run_id, f_epoch AS epoch,
         first(suggestion ORDER BY ts, event_id) FILTER (WHERE suggestion IS NOT NULL) AS suggestion,
         first(acq_sum ORDER BY ts, event_id) FILTER (WHERE acq_sum IS NOT NULL) AS acq_sum,
         first(valid_r2 ORDER BY ts, event_id) FILTER (WHERE valid_r2 IS NOT NULL) AS valid_r2
  FROM filled WHERE f_epoch IS NOT NULL GROUP BY run_id, f_epoch)"""


# ---------------------------------------------------------------- J1
@register("collapse_history", rounded(HIST + ", " + SQL_COLLAPSED + "\nSELECT * FROM coll",
                                      ["epoch"] + FX.HIST_METRICS))
def q_collapse_history(spark, d):
    return collapsed(spark, d)


# ---------------------------------------------------------------- J13
N_BOOT = 1000


def _j13_sql() -> str:
    return rounded(HIST + ", " + SQL_COLLAPSED + f""",
sel AS (SELECT c.*, CASE WHEN c.run_id % 2 = 0 THEN 'arm0' ELSE 'arm1' END AS label
        FROM coll c WHERE suggestion IS NOT NULL),
base AS (SELECT label, epoch, round(suggestion * 100)::BIGINT AS x, run_id FROM sel),
{sql_resamples('base', 'label, epoch', 'x', 'run_id', N_BOOT)},
rm AS (SELECT label, epoch, rep, sum(x) / (count(*) * 100.0::DOUBLE) AS m FROM drawn GROUP BY label, epoch, rep),
ci AS (SELECT label, epoch, {sql_percentile('m', 0.025)} AS ci_lo, {sql_percentile('m', 0.975)} AS ci_hi
       FROM rm GROUP BY label, epoch),
g AS (SELECT label, epoch, avg(suggestion) AS mean, count(suggestion) AS n FROM sel GROUP BY label, epoch)
SELECT g.label, g.epoch, g.mean, g.n, ci.ci_lo, ci.ci_hi FROM g LEFT JOIN ci USING (label, epoch)""",
                   ["epoch", "mean", "ci_lo", "ci_hi"])


@register("bo_paths", _j13_sql())
def q_bo_paths(spark, d):
    c = collapsed(spark, d)
    sel = c.select("run_id").distinct().withColumn(
        "label", F.when(F.col("run_id") % 2 == 0, "arm0").otherwise("arm1"))
    return H.bo_paths(c, sel, "run_id", "epoch", "suggestion", "label", n_boot=N_BOOT, seed=0, scale=2)


# ---------------------------------------------------------------- J14
@register("best_so_far", rounded(HIST + """
SELECT run_id, event_id, max(suggestion) OVER (PARTITION BY run_id ORDER BY ts, event_id
                                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far
FROM hist""", ["best_so_far"]))
def q_best_so_far(spark, d):
    return H.best_so_far(FX.hist(spark, d), "run_id", ORDER, "suggestion").select("run_id", "event_id",
                                                                                  "best_so_far")


# ---------------------------------------------------------------- D5
@register("rescale_range", rounded(HIST + """
SELECT run_id, event_id, CASE WHEN mx = mn THEN 0.0 ELSE (acq_sum - mn) / (mx - mn) END AS acq_scaled
FROM hist, (SELECT min(acq_sum) AS mn, max(acq_sum) AS mx FROM hist) s WHERE acq_sum IS NOT NULL""",
                                   ["acq_scaled"]))
def q_rescale_range(spark, d):
    h = FX.hist(spark, d).filter(F.col("acq_sum").isNotNull())
    return H.rescale_range(h, "acq_sum", 0.0, 1.0, out_col="acq_scaled").select("run_id", "event_id",
                                                                                 "acq_scaled")


# ---------------------------------------------------------------- J15
@register("global_optimum", rounded(FX.with_sql(FX.SQL_RUNS, FX.SQL_HIST) + ", " + SQL_COLLAPSED + """
SELECT data_path, e.epoch::BIGINT AS epoch, arg_min(target_stat_max, run_id) AS optimum
FROM runs, range(0, (SELECT max(epoch)::BIGINT + 1 FROM coll)) e(epoch)
GROUP BY data_path, e.epoch""", ["optimum"]))
def q_global_optimum(spark, d):
    n = collapsed(spark, d).agg((F.max("epoch").cast("bigint") + 1)).first()[0]
    runs = FX.runs(spark, d).withColumn("n_epochs", F.lit(n))
    return H.global_optimum(runs, "data_path", "target_stat_max", "run_id", "n_epochs")


# ---------------------------------------------------------------- J16
@register("mirrored_metric", rounded(FX.with_sql(FX.SQL_RUNS) + """
, g AS (SELECT representation, acquisition, avg(valid_r2) AS mean,
              CASE WHEN acquisition = 'ei' THEN -avg(valid_r2) ELSE avg(valid_r2) END AS value
       FROM runs WHERE representation IS NOT NULL AND acquisition IS NOT NULL GROUP BY representation, acquisition)
SELECT g.*, (SELECT max(abs(value)) FROM g) AS bound FROM g""".replace("\n, g AS", ", g AS"),
                                     ["mean", "value", "bound"]))
def q_mirrored_metric(spark, d):
    return H.mirrored_metric(FX.runs(spark, d), ["representation"], "acquisition", "valid_r2")


# ---------------------------------------------------------------- J17
@register("suggestions_vs_random", rounded(HIST + """
SELECT run_id, event_id, suggestion, 'chosen' AS arm_label FROM hist
WHERE suggestion IS NOT NULL AND run_id IN (SELECT run_id FROM hist WHERE arm = 0 AND valid_r2 IS NOT NULL)
UNION ALL
SELECT run_id, event_id, suggestion, 'random' AS arm_label FROM hist
WHERE suggestion IS NOT NULL AND run_id IN (SELECT run_id FROM hist WHERE arm = 1)""", ["suggestion"]))
def q_suggestions_vs_random(spark, d):
    h = FX.hist(spark, d)
    chosen = h.filter((F.col("arm") == 0) & F.col("valid_r2").isNotNull()).select("run_id").distinct()
    rnd = h.filter(F.col("arm") == 1).select("run_id").distinct()
    return H.suggestions_vs_random(h, chosen, rnd, "run_id", "suggestion").select(
        "run_id", "event_id", "suggestion", "arm_label")
