"""Catalogue entries for results analysis (Entry 3): B1, B7, J2-J12."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import results as R
from platewise.plans.registry import register, rounded, sql_fmt2, sql_percentile
from platewise.sources import fixtures as FX

RUNS = FX.with_sql(FX.SQL_RUNS)

# ---------------------------------------------------------------- B1
B1_FILTER = {"kernel": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "init": ["F", "O"],
             "acquisition": "ucb", "data_path": "data/plate_1.csv"}


@register("filter_by_dict", rounded(RUNS + """
SELECT run_id, representation, kernel, init, acquisition, n_bits, data_path, valid_r2 FROM runs
WHERE kernel IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND init IN ('F', 'O') AND acquisition = 'ucb'
  AND data_path = 'data/plate_1.csv'""", ["valid_r2"]))
def q_filter_by_dict(spark, d):
    runs = FX.runs(spark, d)
    return R.filter_by_dict(runs, B1_FILTER).select(
        "run_id", "representation", "kernel", "init", "acquisition", "n_bits", "data_path", "valid_r2")


# ---------------------------------------------------------------- B7
@register("distinct_levels", RUNS + """
SELECT kernel, min(run_id) AS first_pos, row_number() OVER (ORDER BY min(run_id), kernel) AS level_rank
FROM runs WHERE kernel IS NOT NULL GROUP BY kernel""")
def q_distinct_levels(spark, d):
    return R.distinct_levels(FX.runs(spark, d), "kernel", "run_id").select(
        "kernel", "first_pos", F.col("level_rank").cast("bigint").alias("level_rank"))


# ---------------------------------------------------------------- J2
SHARE_METRICS = [f"top_{k}_count" for k in FX.TOP_KS] + [f"quantile_{q}_count" for q in FX.QUANTILES]


# most hits on a plate of 720 rows, stated for the SQL side on its own
SHARE_OF = {"top_1_count": 1, "top_3_count": 3, "top_5_count": 5, "top_10_count": 10, "quantile_75_count": 180,
            "quantile_90_count": 72, "quantile_95_count": 36, "quantile_99_count": 7}


def _sql_share() -> str:
    cols = [f"{m}::DOUBLE / {SHARE_OF[m]}.0 AS {m}" for m in SHARE_METRICS]
    return rounded(RUNS + f"SELECT run_id, valid_r2, {', '.join(cols)} FROM runs",
                   ["valid_r2"] + SHARE_METRICS)


@register("counts_to_share", _sql_share())
def q_counts_to_share(spark, d):
    runs = FX.runs(spark, d).select("run_id", "valid_r2", *SHARE_METRICS)
    hits = {f"top_{k}_count": R.Hits(best=k) for k in FX.TOP_KS}
    hits |= {f"quantile_{p}_count": R.Hits(percentile=p) for p in FX.QUANTILES}
    return R.counts_to_share(runs, hits)


# ---------------------------------------------------------------- J3
@register("group_means", rounded(RUNS + """
SELECT representation, kernel, n_bits, avg(valid_r2) AS valid_r2, avg(top_5_count) AS top_5_count
FROM runs WHERE representation IS NOT NULL AND kernel IS NOT NULL AND n_bits IS NOT NULL
GROUP BY representation, kernel, n_bits""", ["valid_r2", "top_5_count"]))
def q_group_means(spark, d):
    return R.group_means(FX.runs(spark, d), ["representation", "kernel", "n_bits"],
                         ["valid_r2", "top_5_count"])


# ---------------------------------------------------------------- J4
@register("best_config", rounded(RUNS + """
, m AS (SELECT representation, kernel, init, avg(valid_r2) AS valid_r2, avg(top_1_count) AS top_1_count,
              avg(top_5_count) AS top_5_count
       FROM runs WHERE acquisition IN ('ucb', 'ei') AND representation IS NOT NULL AND kernel IS NOT NULL
         AND init IS NOT NULL GROUP BY representation, kernel, init),
l AS (UNPIVOT m ON valid_r2, top_1_count, top_5_count INTO NAME metric VALUE value)
SELECT metric, representation, kernel, init, value FROM (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, representation, kernel, init) AS rn
  FROM l WHERE value IS NOT NULL) WHERE rn = 1""".replace("\n, m AS", ", m AS"), ["value"]))
def q_best_config(spark, d):
    return R.best_config(FX.runs(spark, d), "representation", ["valid_r2", "top_1_count", "top_5_count"],
                         ["kernel", "init"], filters={"acquisition": ["ucb", "ei"]})


# ---------------------------------------------------------------- J5
J5_BASE = {"acquisition": ["ucb", "ei"], "kernel": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}
J5_CONFIG = {"AUTOMOBILE": ["n_bits"], "BUILDING": ["n_bits"], "FURNITURE": ["n_bits", "data_path"],
             "HOUSEHOLD": [], "MACHINERY": []}
J5_SQL = RUNS + """, d AS (
  SELECT *, CASE WHEN representation IN ('FURNITURE') THEN data_path END AS m_data_path,
            CASE WHEN representation IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN n_bits END AS m_n_bits
  FROM runs
  WHERE acquisition IN ('ucb', 'ei') AND kernel IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
    AND representation IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')
    AND (representation NOT IN ('FURNITURE') OR data_path IS NOT NULL)
    AND (representation NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') OR n_bits IS NOT NULL)),
g AS (SELECT representation, m_data_path, m_n_bits, avg(top_5_count) AS mean FROM d
      GROUP BY representation, m_data_path, m_n_bits),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY representation
                                                  ORDER BY mean DESC, m_data_path, m_n_bits) AS rn
                     FROM g WHERE mean IS NOT NULL) WHERE rn = 1)
SELECT d.* EXCLUDE (m_data_path, m_n_bits) FROM d
WHERE EXISTS (SELECT 1 FROM b WHERE b.representation = d.representation
              AND b.m_data_path IS NOT DISTINCT FROM d.m_data_path AND b.m_n_bits IS NOT DISTINCT FROM d.m_n_bits)"""


def best_runs(spark, d):
    return R.best_config_runs(FX.runs(spark, d), J5_BASE, "top_5_count", "representation", J5_CONFIG)


@register("best_config_runs", rounded(J5_SQL, ["valid_r2", "target_stat_max"]))
def q_best_config_runs(spark, d):
    return best_runs(spark, d)


# ---------------------------------------------------------------- J6 / J7
def _sql_describe(by: str, metrics: list[str], ranked: bool) -> tuple[str, list[str]]:
    parts, dbl = [], []
    for m in metrics:
        parts += [f"count({m}) AS {m}_count", f"avg({m}) AS {m}_mean", f"stddev_samp({m}) AS {m}_std",
                  f"min({m})::DOUBLE AS {m}_min", f"{sql_percentile(m, 0.25)} AS {m}_25",
                  f"{sql_percentile(m, 0.5)} AS {m}_50", f"{sql_percentile(m, 0.75)} AS {m}_75",
                  f"max({m})::DOUBLE AS {m}_max"]
        dbl += [f"{m}_{s}" for s in ("mean", "std", "min", "25", "50", "75", "max")]
    body = f"SELECT {by}, {', '.join(parts)} FROM b WHERE {by} IS NOT NULL GROUP BY {by}"
    if ranked:
        body = (f"SELECT *, row_number() OVER (ORDER BY {metrics[0]}_mean DESC NULLS LAST, {by}) AS rank "
                f"FROM ({body})")
    return body, dbl


DESC_METRICS = ["top_5_count", "valid_r2"]


def _describe_sql(ranked: bool) -> str:
    body, dbl = _sql_describe("kernel", DESC_METRICS, ranked)
    # the J5 selection is the input, as in the reference's analysis notebook
    src = J5_SQL.replace("\nSELECT d.* EXCLUDE", ",\nb_sel AS (SELECT d.* EXCLUDE") + ")\n"
    return rounded(src + body.replace("FROM b WHERE", "FROM b_sel WHERE"), dbl)


@register("describe_by", _describe_sql(False))
def q_describe_by(spark, d):
    return R.describe_by(best_runs(spark, d), ["kernel"], DESC_METRICS)


@register("rank_groups", _describe_sql(True))
def q_rank_groups(spark, d):
    desc = R.describe_by(best_runs(spark, d), ["kernel"], DESC_METRICS)
    return R.rank_groups(desc, ["kernel"], DESC_METRICS[0]).withColumn("rank", F.col("rank").cast("bigint"))


# ---------------------------------------------------------------- J8 / J9
LABEL_METRICS = ["valid_r2", "target_stat_max"]


def _label_sql(by: list[str]) -> tuple[str, list[str]]:
    parts, dbl = [], []
    for m in LABEL_METRICS:
        parts += [f"avg({m}) AS {m}_mean", f"stddev_samp({m}) AS {m}_std"]
        dbl += [f"{m}_mean", f"{m}_std"]
    keys = ", ".join(by)
    nn = " AND ".join(f"{k} IS NOT NULL" for k in by)
    inner = f"SELECT {keys}, {', '.join(parts)} FROM runs WHERE {nn} GROUP BY {keys}"
    labels = ", ".join(f"{sql_fmt2(m + '_mean')} || ' ± ' || {sql_fmt2(m + '_std')} AS {m}_label"
                       for m in LABEL_METRICS)
    return f"SELECT *, {labels} FROM ({inner})", dbl


@register("mean_sd_label", rounded(RUNS + _label_sql(["representation", "acquisition"])[0],
                                   _label_sql(["representation", "acquisition"])[1]))
def q_mean_sd_label(spark, d):
    return R.mean_sd_label(FX.runs(spark, d), ["representation", "acquisition"], LABEL_METRICS)


@register("parse_mean", rounded(RUNS + f"""
SELECT representation, acquisition, TRY_CAST(trim(split_part(valid_r2_label, '±', 1)) AS DOUBLE) AS parsed_mean
FROM ({_label_sql(["representation", "acquisition"])[0]})""", ["parsed_mean"]))
def q_parse_mean(spark, d):
    lab = R.mean_sd_label(FX.runs(spark, d), ["representation", "acquisition"], LABEL_METRICS)
    return lab.select("representation", "acquisition", R.parse_mean("valid_r2_label").alias("parsed_mean"))


# ---------------------------------------------------------------- J10
def _factor_sql() -> str:
    blocks = []
    for i, (label, col) in enumerate(R.FACTOR_TYPES):
        blocks.append(f"""SELECT {i} AS type_order, '{label}' AS t, {col}::VARCHAR AS Parameter,
  avg(valid_r2) AS m0, {sql_fmt2('avg(valid_r2)')} || ' ± ' || {sql_fmt2('stddev_samp(valid_r2)')} AS valid_r2,
  {sql_fmt2('avg(target_stat_max)')} || ' ± ' || {sql_fmt2('stddev_samp(target_stat_max)')} AS target_stat_max
FROM runs WHERE {col} IS NOT NULL GROUP BY {col}""")
    u = "\nUNION ALL\n".join(blocks)
    return RUNS + f"""SELECT type_order, pos, CASE WHEN pos = 1 THEN t ELSE '' END AS "Type", Parameter,
       valid_r2, target_stat_max
FROM (SELECT *, row_number() OVER (PARTITION BY type_order ORDER BY m0 DESC NULLS LAST, Parameter) AS pos
      FROM ({u}))"""


@register("factor_table", _factor_sql())
def q_factor_table(spark, d):
    t = R.factor_table(FX.runs(spark, d), LABEL_METRICS)
    return t.withColumn("pos", F.col("pos").cast("bigint"))


# ---------------------------------------------------------------- J11
def _combo_sql() -> tuple[str, list[str]]:
    return _label_sql(["representation", "kernel", "init", "acquisition"])


@register("all_combinations_table", rounded(RUNS + _combo_sql()[0], _combo_sql()[1]))
def q_combo_table(spark, d):
    return R.combo_table(FX.runs(spark, d), ["representation", "kernel", "init", "acquisition"],
                         LABEL_METRICS)


# ---------------------------------------------------------------- J12
@register("group_counts", RUNS + """
SELECT representation, count(run_id) AS run_id, count(name) AS name, count(kernel) AS kernel,
       count(init) AS init, count(acquisition) AS acquisition, count(n_bits) AS n_bits,
       count(data_path) AS data_path, count(valid_r2) AS valid_r2
FROM runs WHERE acquisition = 'ucb' GROUP BY representation""")
def q_group_counts(spark, d):
    runs = FX.runs(spark, d).select("run_id", "name", "representation", "kernel", "init", "acquisition",
                                    "n_bits", "data_path", "valid_r2")
    return R.group_counts(runs, ["representation"], {"acquisition": "ucb"})
