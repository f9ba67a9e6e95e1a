"""Catalogue entries for cleaning and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.operators import clean as B
from platewise.plans.registry import register, rounded
from platewise.sources import fixtures as FX
from platewise.sources.tables import table


# ---------------------------------------------------------------- B2
def _b2_sql() -> str:
    def cnt(ch: str) -> str:
        return f"(length(text) - length(replace(text, '{ch}', '')))"

    br = " ".join(f"WHEN {cnt(o)} <> {cnt(c)} THEN 'unbalanced {o}{c}'" for o, c in B.BRACKET_PAIRS)
    return FX.with_sql(FX.SQL_TEXT) + f"""
SELECT candidate_id, CASE WHEN text IS NULL OR length(trim(text)) = 0 THEN 'empty' {br}
  WHEN regexp_matches(text, '{B.DISALLOWED_CHARS}') THEN 'disallowed character' END AS reject_reason
FROM txt"""


@register("validate_rows", _b2_sql())
def q_validate_rows(spark, d):
    t = FX.text(spark, d)
    clean, rejects = B.validate_rows(t, "text")
    return clean.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rejects) \
        .select("candidate_id", "reject_reason")


# ---------------------------------------------------------------- B4
@register("dedup_features", FX.with_sql(FX.SQL_ONEHOT) + """
SELECT min(candidate_id) AS candidate_id FROM onehot GROUP BY features""")
def q_dedup_features(spark, d):
    return B.dedup_features(FX.onehot(spark, d)).select("candidate_id")


# ---------------------------------------------------------------- B5
@register("remove_rows", rounded(FX.with_sql(FX.SQL_CAND) + """
SELECT candidate_id, objective FROM cand
WHERE candidate_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)""", ["objective"]))
def q_remove_rows(spark, d):
    ids = table(spark, d, "part").filter(F.col("p_size") < 10).select(F.col("p_partkey").alias("candidate_id"))
    return B.remove_rows(FX.cand(spark, d).select("candidate_id", "objective"), ids)


# ---------------------------------------------------------------- B6
@register("lookup_original", FX.with_sql(FX.SQL_ONEHOT) + """
, firsts AS (SELECT features, min(candidate_id) AS original_id FROM onehot GROUP BY features)
SELECT o.candidate_id AS query_id, f.original_id FROM onehot o JOIN firsts f ON o.features = f.features
WHERE o.candidate_id IN (SELECT p_partkey FROM part WHERE p_size = 1)""")
def q_lookup_original(spark, d):
    oh = FX.onehot(spark, d)
    qids = table(spark, d, "part").filter(F.col("p_size") == 1).select(F.col("p_partkey").alias("candidate_id"))
    qv = oh.join(qids, "candidate_id", "left_semi").withColumnRenamed("candidate_id", "query_id")
    return B.lookup_original(oh, qv)
