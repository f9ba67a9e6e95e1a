"""Fixture views built from the supplied tables, once as DataFrames and once as SQL.

The query catalogue builds every Spark query on the DataFrame form and every
DuckDB oracle on the SQL form, so both sides start from the same rows. The
views re-cast TPC-H-like tables into the shapes the screening engine works on:
candidates, feature vectors, predictions, campaign runs and run logs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.operators.ordered import next_in_group
from platewise.session import spread
from platewise.sources.tables import table

# ---------------------------------------------------------------- F-cand
def cand(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    # the mean is taken over integer cents, so both engines get the same double
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    sales = (table(spark, d, "lineitem").groupBy("l_partkey")
             .agg((F.sum(cents) / (F.lit(100.0) * F.count(cents))).alias("avg_price")))
    j = part.join(sales, part.p_partkey == sales.l_partkey, "left")
    return j.select(
        F.col("p_partkey").alias("candidate_id"), "p_name", "p_brand", "p_type", "p_size",
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("double"))
        .otherwise(F.col("avg_price")).alias("objective"))


SQL_CAND = """cand AS (
  SELECT p.p_partkey AS candidate_id, p.p_name, p.p_brand, p.p_type, p.p_size,
         CASE WHEN p.p_partkey % 11 = 0 THEN NULL ELSE s.avg_price END AS objective
  FROM part p LEFT JOIN (SELECT l_partkey, sum(round(l_extendedprice * 100)::BIGINT)::BIGINT / (100.0::DOUBLE * count(l_extendedprice)) AS avg_price
                         FROM lineitem GROUP BY l_partkey) s ON p.p_partkey = s.l_partkey)"""


# ---------------------------------------------------------------- F-onehot
def onehot(spark: SparkSession, d: str) -> DataFrame:
    from platewise.operators.features import one_hot_array
    part = table(spark, d, "part").select(F.col("p_partkey").alias("candidate_id"),
                                          "p_brand", "p_type")
    return one_hot_array(part, ["p_brand", "p_type"], out_col="features").select(
        "candidate_id", "features")


SQL_ONEHOT = """onehot AS (
  SELECT p_partkey AS candidate_id,
         list_concat(list_transform(lv.lb, lambda l: CASE WHEN l = p_brand THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
                     list_transform(lv.lt, lambda l: CASE WHEN l = p_type THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS features
  FROM part CROSS JOIN (SELECT list(DISTINCT p_brand ORDER BY p_brand) AS lb,
                               list(DISTINCT p_type ORDER BY p_type) AS lt FROM part) lv)"""


# ---------------------------------------------------------------- F-vec
def vec(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    feats = F.transform("embedding", lambda x: x.cast("double"))
    return (e.select(F.col("vec_id").alias("candidate_id"), feats.alias("features"), "label")
            .withColumn("y", F.round(
                F.lit(100.0) * (F.lit(0.5) * F.col("features")[0] - F.lit(0.3) * F.col("features")[1]
                                + F.col("features")[2] * F.col("features")[3]) + F.col("label"), 6)))


SQL_VEC = """vec AS (
  SELECT vec_id AS candidate_id, list_transform(embedding, lambda x: x::DOUBLE) AS features, label,
         round(100.0::DOUBLE * (0.5::DOUBLE * embedding[1]::DOUBLE - 0.3::DOUBLE * embedding[2]::DOUBLE
               + embedding[3]::DOUBLE * embedding[4]::DOUBLE) + label, 6) AS y
  FROM embeddings)"""


# ---------------------------------------------------------------- F-text (whole texts, every document)
def text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("candidate_id"), "text", "lang")
    return spread(docs, "candidate_id")


SQL_TEXT = """txt AS (SELECT doc_id AS candidate_id, text, lang FROM documents)"""


# ---------------------------------------------------------------- F-pair
def pair(spark: SparkSession, d: str, block_size: int = 100_000) -> DataFrame:
    docs = spread(table(spark, d, "documents").select("doc_id", "lang", "text"), "doc_id")
    nxt = next_in_group(docs.select("doc_id", "lang"), ["lang"], "doc_id", block_size, "next_id")
    nxt = nxt.filter(F.col("next_id").isNotNull())
    left = docs.select(F.col("doc_id").alias("l_id"), F.col("text").alias("left_text"))
    right = docs.select(F.col("doc_id").alias("r_id"), F.col("text").alias("right_text"))
    return (nxt.join(left, nxt.doc_id == left.l_id).join(right, nxt.next_id == right.r_id)
            .select(F.col("doc_id").alias("candidate_id"), "left_text", "right_text"))


SQL_PAIR = """pr AS (
  SELECT a.doc_id AS candidate_id, a.text AS left_text, b.text AS right_text
  FROM (SELECT doc_id, text, lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id) AS next_id
        FROM documents) a JOIN documents b ON b.doc_id = a.next_id)"""


# ---------------------------------------------------------------- F-desc
def desc(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    return (part.groupBy(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")).alias("key"))
            .agg(F.avg("p_retailprice").alias("d1"), F.avg("p_size").cast("double").alias("d2"),
                 F.min("p_partkey").alias("_k"))
            .filter(F.col("_k") % 4 != 0).drop("_k"))


SQL_DESC = """descr AS (
  SELECT key, d1, d2 FROM (
    SELECT '  ' || upper(p_name) || ' ' AS key, avg(p_retailprice) AS d1, avg(p_size)::DOUBLE AS d2,
           min(p_partkey) AS k
    FROM part GROUP BY 1) WHERE k % 4 <> 0)"""


# ---------------------------------------------------------------- F-graph
# parts are the even node ids, suppliers the odd ones: the two never meet at any size


def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select((F.col("p_partkey") * 2).alias("node_id"),
                                           F.col("p_size").cast("double").alias("x"))
    sups = table(spark, d, "supplier").select(
        (F.col("s_suppkey") * 2 + 1).alias("node_id"), (F.col("s_acctbal") / 1000).alias("x"))
    return parts.unionByName(sups)


def graph_bonds(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
            .select((F.col("l_partkey") * 2).alias("src"),
                    (F.col("l_suppkey") * 2 + 1).alias("dst"),
                    (F.col("l_partkey") % 4).cast("int").alias("label")))


SQL_GRAPH = f"""gnodes AS (
  SELECT p_partkey * 2 AS node_id, p_size::DOUBLE AS x FROM part
  UNION ALL SELECT s_suppkey * 2 + 1 AS node_id, s_acctbal / 1000 AS x FROM supplier),
gbonds AS (
  SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst, (l_partkey % 4)::INTEGER AS label
  FROM lineitem)"""


# ---------------------------------------------------------------- F-pred
def pred(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    g = (li.groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
         .agg(F.min("l_extendedprice").alias("p"), F.min("l_discount").alias("disc"),
              F.min("l_tax").alias("tax"), F.min("l_linestatus").alias("split")))
    y = F.col("p") / 1000
    return g.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", y.alias("y"),
                    (y * (F.lit(1.0) + F.col("disc") - F.lit(0.05))).alias("mu"),
                    (F.lit(1.0) + F.lit(50.0) * F.col("tax")).alias("var"), "split")


SQL_PRED = """pred AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p / 1000 AS y,
         (p / 1000) * (1.0::DOUBLE + disc - 0.05::DOUBLE) AS mu, 1.0::DOUBLE + 50.0::DOUBLE * tax AS var, split
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, min(l_extendedprice) AS p,
               min(l_discount) AS disc, min(l_tax) AS tax, min(l_linestatus) AS split
        FROM lineitem GROUP BY 1, 2, 3, 4))"""


# ---------------------------------------------------------------- F-runs
TOP_KS = (1, 3, 5, 10)
QUANTILES = (75, 90, 95, 99)


def runs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    c = table(spark, d, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    cols = [
        F.col("o_orderkey").alias("run_id"),
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("c_mktsegment").alias("representation"),
        F.col("o_orderpriority").alias("kernel"),
        F.col("o_orderstatus").alias("init"),
        F.when(F.col("o_custkey") % 2 == 0, "ucb").otherwise("ei").alias("acquisition"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit(None).cast("bigint"))
        .otherwise(F.lit(512) * (F.lit(1) + F.col("o_custkey") % 3)).cast("bigint").alias("n_bits"),
        F.concat(F.lit("data/plate_"), (F.lit(1) + F.col("o_orderkey") % 4).cast("string"),
                 F.lit(".csv")).alias("data_path"),
        (F.col("o_totalprice") / 500000).alias("valid_r2"),
        F.col("c_acctbal").alias("target_stat_max"),
    ]
    cols += [(F.col("o_orderkey") % (k + 1)).alias(f"top_{k}_count") for k in TOP_KS]
    cols += [(F.col("o_custkey") % (720 * (100 - q) // 100 + 1)).alias(f"quantile_{q}_count")
             for q in QUANTILES]
    return j.select(*cols)


def _sql_runs() -> str:
    tops = ", ".join(f"o_orderkey % {k + 1} AS top_{k}_count" for k in TOP_KS)
    qs = ", ".join(f"o_custkey % {720 * (100 - q) // 100 + 1} AS quantile_{q}_count" for q in QUANTILES)
    return f"""runs AS (
  SELECT o_orderkey AS run_id, 'run-' || o_orderkey::VARCHAR AS name, c_mktsegment AS representation,
         o_orderpriority AS kernel, o_orderstatus AS init,
         CASE WHEN o_custkey % 2 = 0 THEN 'ucb' ELSE 'ei' END AS acquisition,
         CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 512 * (1 + o_custkey % 3) END::BIGINT AS n_bits,
         'data/plate_' || (1 + o_orderkey % 4)::VARCHAR || '.csv' AS data_path,
         o_totalprice / 500000 AS valid_r2, c_acctbal AS target_stat_max, {tops}, {qs}
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


SQL_RUNS = _sql_runs()


# ---------------------------------------------------------------- F-hist
def hist(spark: SparkSession, d: str) -> DataFrame:
    return hist_from(table(spark, d, "events"))


def hist_from(e: DataFrame) -> DataFrame:
    """The run-log view of an events DataFrame (batch or streaming)."""
    et = F.col("event_type")
    return e.select(
        F.col("user_id").alias("run_id"), "ts", "event_id",
        F.when(et == "signup", F.get_json_object("props", "$.k").cast("double")).alias("epoch"),
        F.when(et == "click", F.col("value")).alias("suggestion"),
        F.when(et == "view", F.col("value")).alias("acq_sum"),
        F.when(et == "purchase", F.col("value") / 1000).alias("valid_r2"),
        (F.col("user_id") % 2).cast("int").alias("arm"))


SQL_HIST = """hist AS (
  SELECT user_id AS run_id, ts, event_id,
         CASE WHEN event_type = 'signup' THEN json_extract(props, '$.k')::DOUBLE END AS epoch,
         CASE WHEN event_type = 'click' THEN value END AS suggestion,
         CASE WHEN event_type = 'view' THEN value END AS acq_sum,
         CASE WHEN event_type = 'purchase' THEN value / 1000 END AS valid_r2,
         (user_id % 2)::INTEGER AS arm
  FROM events)"""

HIST_METRICS = ["suggestion", "acq_sum", "valid_r2"]


def with_sql(*ctes: str) -> str:
    """Join fixture CTEs into a WITH prefix."""
    return "WITH " + ",\n".join(ctes) + "\n"
