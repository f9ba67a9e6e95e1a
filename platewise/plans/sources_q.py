"""Catalogue entries for sources and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import reshape as A
from platewise.plans.registry import register, rounded
from platewise.sources import fixtures as FX
from platewise.sources.tables import read_candidates, table

RUNS = FX.with_sql(FX.SQL_RUNS)


# ---------------------------------------------------------------- A1
@register("read_candidates", rounded("""
SELECT p_partkey AS candidate_id, p_name, p_brand, p_type, p_size, p_retailprice FROM part""",
                                     ["p_retailprice"]))
def q_read_candidates(spark, d):
    schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    return read_candidates(spark, f"{d}/part.parquet", schema, id_col="p_partkey") \
        .withColumnRenamed("p_partkey", "candidate_id")


# ---------------------------------------------------------------- A2
@register("load_labelled", """
SELECT d.doc_id, d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL""")
def q_load_labelled(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", "quality")
    return A.load_labelled(docs.join(lab, "doc_id", "left"), ["doc_id", "lang", "n_chars"], "quality")


# ---------------------------------------------------------------- A3
@register("ingest_run_logs", """
SELECT event_id, user_id AS run_id, event_type, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def q_ingest_run_logs(spark, d):
    ev = table(spark, d, "events").select("event_id", F.col("user_id").alias("run_id"), "event_type", "props")
    return A.ingest_run_logs(ev, "props", "k bigint").select("event_id", "run_id", "event_type",
                                                             F.col("payload.k").alias("k"))


# ---------------------------------------------------------------- A4
def nested_runs(spark, d):
    r = FX.runs(spark, d)
    return r.select(
        "run_id",
        F.struct(F.struct(F.struct(F.col("representation"), F.col("n_bits")).alias("featurizer"),
                          F.col("data_path")).alias("data"),
                 F.struct(F.col("acquisition")).alias("model"),
                 F.struct(F.col("kernel"), F.col("init")).alias("surrogate")).alias("config"),
        F.struct(F.col("valid_r2"), F.col("top_5_count")).alias("summary"))


@register("flatten_config", rounded(RUNS + """
SELECT run_id, representation AS "config.data.featurizer.representation",
       n_bits AS "config.data.featurizer.n_bits", data_path AS "config.data.data_path",
       acquisition AS "config.model.acquisition", kernel AS "config.surrogate.kernel",
       init AS "config.surrogate.init", valid_r2 AS "summary.valid_r2", top_5_count AS "summary.top_5_count"
FROM runs""", ["summary.valid_r2"]))
def q_flatten_config(spark, d):
    return A.flatten_config(nested_runs(spark, d))


# ---------------------------------------------------------------- A5
def dotted_runs(spark, d):
    r = FX.runs(spark, d)
    return r.select(
        "run_id",
        F.col("representation").alias("data.featurizer.representation"),
        F.col("n_bits").alias("data.featurizer.n_bits"),
        F.col("kernel").alias("surrogate.kernel"),
        F.when(F.col("init") == "F", "True").otherwise("False").alias("surrogate.normalize"),
        F.when(F.col("init") == "F", "True").when(F.col("init") == "O", "False")
        .otherwise(F.col("init")).alias("surrogate.standardize"))


@register("nest_config", RUNS + """
SELECT run_id, representation AS representation, n_bits AS n_bits, kernel AS kernel,
       (init = 'F') AS normalize,
       CASE WHEN init = 'F' THEN 'True' WHEN init = 'O' THEN 'False' ELSE init END AS standardize
FROM runs""")
def q_nest_config(spark, d):
    n = A.nest_config(dotted_runs(spark, d))
    return n.select("run_id", F.col("data.featurizer.representation").alias("representation"),
                    F.col("data.featurizer.n_bits").alias("n_bits"), F.col("surrogate.kernel").alias("kernel"),
                    F.col("surrogate.normalize").alias("normalize"),
                    F.col("surrogate.standardize").alias("standardize"))


# ---------------------------------------------------------------- A6
@register("zip_columns", rounded(RUNS + """
SELECT run_id, valid_r2, top_5_count, representation, kernel, name FROM runs""", ["valid_r2"]))
def q_zip_columns(spark, d):
    r = FX.runs(spark, d)
    return A.zip_columns(r.select("run_id", "valid_r2", "top_5_count"),
                         r.select("run_id", "representation", "kernel"), "run_id",
                         r.select("run_id", "name"))


# ---------------------------------------------------------------- A7
@register("drop_prefixed", rounded(RUNS + """
SELECT run_id, name, representation, kernel, init, acquisition, n_bits, data_path, valid_r2, target_stat_max
FROM runs""", ["valid_r2", "target_stat_max"]))
def q_drop_prefixed(spark, d):
    return A.drop_prefixed(FX.runs(spark, d), ["top_", "quantile_"])


# ---------------------------------------------------------------- A8
@register("drop_all_null", rounded(FX.with_sql(FX.SQL_HIST) + """
SELECT run_id, event_id, epoch, suggestion, acq_sum, valid_r2 FROM hist""",
                                   ["epoch", "suggestion", "acq_sum", "valid_r2"]))
def q_drop_all_null(spark, d):
    h = FX.hist(spark, d).join(table(spark, d, "events").select("event_id", "event_type"), "event_id")
    # a metric that no event of this log reports
    h = h.withColumn("noise", F.when(F.col("event_type") == "refund", F.col("valid_r2")))
    return A.drop_all_null(h.select("run_id", "event_id", "epoch", "suggestion", "acq_sum", "valid_r2", "noise"))


# ---------------------------------------------------------------- A9
@register("sort_columns", rounded(RUNS + "SELECT acquisition, kernel, run_id, valid_r2 FROM runs", ["valid_r2"]))
def q_sort_columns(spark, d):
    return A.sort_columns(FX.runs(spark, d).select("valid_r2", "run_id", "kernel", "acquisition"))


# ---------------------------------------------------------------- A10
@register("write_table", rounded(RUNS + "SELECT run_id, valid_r2, data_path FROM runs", ["valid_r2"]))
def q_write_table(spark, d):
    r = FX.runs(spark, d).select("run_id", "valid_r2", "data_path")
    return A.write_and_read_back(r, "runs", partition_by=["data_path"]).select("run_id", "valid_r2", "data_path")


# ---------------------------------------------------------------- A11
PRIORITY_TO_KERNEL_PATH = {
    "1-URGENT": "gpytorch.kernels.linear_kernel.LinearKernel",
    "2-HIGH": "gpytorch.kernels.matern_kernel.MaternKernel",
    "3-MEDIUM": "kernels.fingerprint_kernels.tanimoto_kernel.TanimotoKernel",
    "4-NOT SPECIFIED": "gpytorch.kernels.rq_kernel.RQKernel",
}
STATUS_TO_INIT = {"F": "true_random", "O": "kmeans", "P": "maxmin"}


def raw_runs(spark, d):
    """Runs with the long configuration names and class paths of a tracking export."""
    r = FX.runs(spark, d)
    kern = F.col("kernel")
    kexpr = F.lit("gpytorch.kernels.periodic_kernel.PeriodicKernel")
    for k, v in PRIORITY_TO_KERNEL_PATH.items():
        kexpr = F.when(kern == k, F.lit(v)).otherwise(kexpr)
    iexpr = F.col("init")
    for k, v in STATUS_TO_INIT.items():
        iexpr = F.when(F.col("init") == k, F.lit(v)).otherwise(iexpr)
    long = {v: k for k, v in A.CONFIG_RENAMES.items()}
    return r.select("run_id", F.col("representation").alias(long["representation"]),
                    kexpr.alias(long["kernel"]), iexpr.alias(long["init"]),
                    F.col("n_bits").alias(long["n_bits"]), F.col("acquisition").alias(long["acquisition"]),
                    "valid_r2")


def _a11_sql() -> str:
    kc = " ".join(f"WHEN kernel = '{k}' THEN '{v.rsplit('.', 1)[1][:-len('Kernel')]}'"
                  for k, v in PRIORITY_TO_KERNEL_PATH.items())
    ic = " ".join(f"WHEN init = '{k}' THEN '{A.INIT_RECODE.get(v, v)}'" for k, v in STATUS_TO_INIT.items())
    return rounded(RUNS + f"""
SELECT run_id, representation, CASE {kc} ELSE 'gpytorch.kernels.periodic_kernel.PeriodicKernel' END AS kernel,
       CASE {ic} ELSE init END AS init, n_bits, acquisition, valid_r2 FROM runs""", ["valid_r2"])


@register("standardise_names", _a11_sql())
def q_standardise_names(spark, d):
    kernels = A.KERNEL_SHORT | {PRIORITY_TO_KERNEL_PATH["3-MEDIUM"]: "Tanimoto"}
    return A.standardise_names(raw_runs(spark, d), kernels=kernels)


# ---------------------------------------------------------------- A12
@register("scale_by_reference", rounded(RUNS + """
SELECT run_id, valid_r2::VARCHAR::DOUBLE / (SELECT arg_min(target_stat_max, run_id) FROM runs) AS valid_r2_txt
FROM runs""", ["valid_r2_txt"]))
def q_scale_by_reference(spark, d):
    r = FX.runs(spark, d).select("run_id", "target_stat_max",
                                 F.col("valid_r2").cast("string").alias("valid_r2_txt"))
    return A.scale_by_reference(r, ["valid_r2_txt"], "target_stat_max", "run_id").select("run_id", "valid_r2_txt")


# ---------------------------------------------------------------- A13
@register("melt_metrics", rounded(RUNS + """
SELECT run_id, representation, metric_type, metric_value FROM (
  UNPIVOT (SELECT run_id, representation, valid_r2, target_stat_max FROM runs)
  ON valid_r2, target_stat_max INTO NAME metric_type VALUE metric_value)""", ["metric_value"]))
def q_melt_metrics(spark, d):
    r = FX.runs(spark, d)
    return A.melt_metrics(r, ["run_id", "representation"], ["valid_r2", "target_stat_max"])


# ---------------------------------------------------------------- A14
@register("concat_tables", rounded(RUNS + """
SELECT run_id, kernel, valid_r2 FROM runs WHERE acquisition = 'ucb'
UNION ALL BY NAME
SELECT run_id, init, top_5_count FROM runs WHERE acquisition = 'ei'""", ["valid_r2"]))
def q_concat_tables(spark, d):
    r = FX.runs(spark, d)
    return A.concat_tables([r.filter(F.col("acquisition") == "ucb").select("run_id", "kernel", "valid_r2"),
                            r.filter(F.col("acquisition") == "ei").select("run_id", "init", "top_5_count")])


# ---------------------------------------------------------------- A15
@register("update_results", rounded(FX.with_sql(FX.SQL_CAND) + """
SELECT c.candidate_id, CASE WHEN r.candidate_id IS NOT NULL THEN r.value ELSE c.objective END AS objective,
       CASE WHEN r.candidate_id IS NOT NULL THEN r.value ELSE 0.0::DOUBLE END AS measured
FROM cand c LEFT JOIN (SELECT p_partkey AS candidate_id, p_retailprice AS value FROM part WHERE p_size > 40) r
  ON c.candidate_id = r.candidate_id""", ["objective", "measured"]))
def q_update_results(spark, d):
    cand = FX.cand(spark, d).select("candidate_id", "objective")
    res = table(spark, d, "part").filter(F.col("p_size") > 40).select(
        F.col("p_partkey").alias("candidate_id"), F.col("p_retailprice").alias("value"))
    out = A.update_results(cand, res, "candidate_id", "objective")
    return A.update_results(out, res, "candidate_id", "measured")
