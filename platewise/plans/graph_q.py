"""Catalogue entries for graph tables and propagation (C10-C12) and the stream monitor (L1)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from platewise.operators import graph as GR
from platewise.plans.registry import register, rounded
from platewise.session import ensure_checkpoint_dir
from platewise.sources import fixtures as FX
from platewise.streaming.monitor import monitor, run_available

GRAPH = FX.with_sql(FX.SQL_GRAPH)
LABELS = [0, 1, 2, 3]
# Scalar edge embeddings standing in for the learned tables (label 4 = self loop).
EDGE_EMB = [0.1, 0.2, 0.3, 0.4, 0.5]
GIN_ROUNDS = 5

EDGES_SQL = """, e2 AS (SELECT src, dst, CASE label WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS label_idx
       FROM (SELECT src, dst, label FROM gbonds UNION ALL SELECT dst AS src, src AS dst, label FROM gbonds)),
el AS (SELECT src, dst, label_idx FROM e2 WHERE label_idx IS NOT NULL
       UNION ALL SELECT node_id, node_id, 4 FROM gnodes)"""


def edges_both(spark, d):
    e, _ = GR.graph_tables(FX.graph_bonds(spark, d), LABELS)
    return e


@register("graph_tables", GRAPH + EDGES_SQL + "\nSELECT src, dst, label_idx FROM e2 WHERE label_idx IS NOT NULL")
def q_graph_tables(spark, d):
    return edges_both(spark, d)


NODE_VOCAB = {"number": list(range(1, 45)), "chirality": ["none", "cw", "ccw", "other"]}
BOND_VOCAB = {"type": LABELS, "direction": ["none", "up", "down"]}
LABELS_SQL = """, ln AS (
  SELECT node_id, CASE WHEN number BETWEEN 1 AND 44 THEN number - 1 END AS number_idx,
         CASE chirality WHEN 'none' THEN 0 WHEN 'cw' THEN 1 WHEN 'ccw' THEN 2 WHEN 'other' THEN 3 END AS chirality_idx
  FROM (SELECT node_id, floor(x)::INTEGER AS number, ['none', 'cw', 'ccw', 'other', 'odd'][node_id % 5 + 1] AS chirality FROM gnodes)),
ok AS (SELECT DISTINCT node_id FROM ln WHERE number_idx IS NOT NULL AND chirality_idx IS NOT NULL),
lb AS (
  SELECT src, dst, CASE WHEN label BETWEEN 0 AND 3 THEN label END AS type_idx,
         CASE direction WHEN 'none' THEN 0 WHEN 'up' THEN 1 WHEN 'down' THEN 2 END AS direction_idx
  FROM (SELECT *, ['none', 'up', 'down', 'both'][(src + dst) % 4 + 1] AS direction FROM gbonds)),
lr AS (
  SELECT *, concat_ws(',', CASE WHEN type_idx IS NULL THEN 'type' END, CASE WHEN direction_idx IS NULL THEN 'direction' END,
                      CASE WHEN src NOT IN (SELECT node_id FROM ok) THEN 'src' END,
                      CASE WHEN dst NOT IN (SELECT node_id FROM ok) THEN 'dst' END) AS reason FROM lb)
SELECT 'node' AS kind, node_id AS a, NULL::BIGINT AS b, number_idx::INTEGER AS first_idx, chirality_idx AS second_idx, NULL::VARCHAR AS reason
FROM ln WHERE number_idx IS NOT NULL AND chirality_idx IS NOT NULL
UNION ALL SELECT 'edge', src, dst, type_idx::INTEGER, direction_idx, NULL FROM lr WHERE reason = ''
UNION ALL SELECT 'edge', dst, src, type_idx::INTEGER, direction_idx, NULL FROM lr WHERE reason = ''
UNION ALL SELECT 'node_reject', node_id, NULL, NULL, NULL, concat_ws(',', CASE WHEN number_idx IS NULL THEN 'number' END,
                 CASE WHEN chirality_idx IS NULL THEN 'chirality' END) FROM ln WHERE number_idx IS NULL OR chirality_idx IS NULL
UNION ALL SELECT 'edge_reject', src, dst, NULL, NULL, reason FROM lr WHERE reason <> ''"""


@register("graph_label_tables", GRAPH + LABELS_SQL)
def q_graph_label_tables(spark, d):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(v) for v in names]), (k + 1).cast("int"))
    nodes = FX.graph_nodes(spark, d).select(
        "node_id", F.floor("x").cast("int").alias("number"), pick([*NODE_VOCAB["chirality"], "odd"], F.col("node_id") % 5).alias("chirality"))
    bonds = FX.graph_bonds(spark, d).withColumnRenamed("label", "type").withColumn(
        "direction", pick([*BOND_VOCAB["direction"], "both"], (F.col("src") + F.col("dst")) % 4))
    n, e, nr, er = GR.labelled_graph(nodes, bonds, NODE_VOCAB, BOND_VOCAB)
    null = F.lit(None)
    out = [t.select(F.lit(kind).alias("kind"), F.col(a).cast("bigint").alias("a"), b.cast("bigint").alias("b"), i.cast("int").alias("first_idx"),
                    j.cast("int").alias("second_idx"), r.cast("string").alias("reason"))
           for t, kind, a, b, i, j, r in ((n, "node", "node_id", null, F.col("number_idx"), F.col("chirality_idx"), null),
                                          (e, "edge", "src", F.col("dst"), F.col("type_idx"), F.col("direction_idx"), null),
                                          (nr, "node_reject", "node_id", null, null, null, F.col("reason")),
                                          (er, "edge_reject", "src", F.col("dst"), null, null, F.col("reason")))]
    return reduce(lambda x, y: x.unionByName(y), out)


def _emb_sql(dtype: str) -> str:
    vals = ", ".join(f"{v!r}::{dtype}" for v in EDGE_EMB)
    return f"[{vals}][label_idx + 1]"


@register("gcn_propagate", rounded(GRAPH + EDGES_SQL + f""",
deg AS (SELECT src AS node_id, CASE WHEN count(*) > 0 THEN 1.0::DOUBLE / sqrt(count(*)) ELSE 0.0::DOUBLE END AS dinv
        FROM el GROUP BY src)
SELECT el.dst AS node_id, sum(a.dinv * b.dinv * (n.x + {_emb_sql('DOUBLE')})) AS x
FROM el JOIN gnodes n ON n.node_id = el.src JOIN deg a ON a.node_id = el.src JOIN deg b ON b.node_id = el.dst
GROUP BY el.dst""", ["x"]))
def q_gcn_propagate(spark, d):
    return GR.gcn_propagate(FX.graph_nodes(spark, d), edges_both(spark, d), EDGE_EMB)


def _gin_sql() -> str:
    dt = "DECIMAL(38,6)"
    parts = [f",\nx0 AS (SELECT node_id, x::{dt} AS x FROM gnodes)"]
    for r in range(1, GIN_ROUNDS + 1):
        relu = r < GIN_ROUNDS
        val = f"sum(p.x + {_emb_sql(dt)})::{dt}"
        parts.append(f""",
x{r} AS MATERIALIZED (SELECT el.dst AS node_id, {f'greatest({val}, 0::{dt})' if relu else val} AS x
       FROM el JOIN x{r - 1} p ON p.node_id = el.src GROUP BY el.dst)""")
    return GRAPH + EDGES_SQL + "".join(parts) + f"\nSELECT node_id, x::DOUBLE AS x FROM x{GIN_ROUNDS}"


@register("gin_propagate", rounded(_gin_sql(), ["x"]))
def q_gin_propagate(spark, d):
    x = GR.gin_propagate(FX.graph_nodes(spark, d), edges_both(spark, d), EDGE_EMB, k=GIN_ROUNDS)
    return x.select("node_id", F.col("x").cast("double").alias("x"))


# ---------------------------------------------------------------- L1
@register("stream_best_so_far", rounded(FX.with_sql(FX.SQL_HIST) + """
SELECT run_id, max(suggestion) AS best_so_far,
       first(acq_sum ORDER BY ts DESC, event_id DESC) FILTER (WHERE acq_sum IS NOT NULL) AS latest_acq_sum,
       count(*) AS n_logged
FROM hist GROUP BY run_id""", ["best_so_far", "latest_acq_sum"]))
def q_stream_best_so_far(spark, d):
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
              .option("maxFilesPerTrigger", 1).parquet(d))
    live = monitor(FX.hist_from(events))
    base = ensure_checkpoint_dir(spark).rstrip("/")
    tag = uuid.uuid4().hex
    return run_available(spark, live, f"{base}/tables/monitor-{tag}", f"{base}/streams/monitor-{tag}")
