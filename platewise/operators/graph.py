"""Graph tables and message passing.

Graphs are two DataFrames, ``nodes(node_id, x)`` and ``edges(src, dst, label)``.
A propagation round is a join of edges with the current node values on ``src``
and a partial ``sum`` grouped by ``dst``: a hub node receiving a third of all
edges is combined map-side before the shuffle, and AQE's skew-join splits a hub
on the join side. Rounds are separated by reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.session import cut_lineage

SELF_LOOP_LABEL = 4


def _index_of(col: str, allowed: Sequence) -> F.Column:
    expr = F.lit(None).cast("int")
    for i, v in reversed(list(enumerate(allowed))):
        expr = F.when(F.col(col) == F.lit(v), F.lit(i)).otherwise(expr)
    return expr


# ------------------------------------------------------------------ C10
def graph_tables(edges: DataFrame, allowed_labels: Sequence, src: str = "src", dst: str = "dst",
                 label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Every bond in both directions with its label replaced by the index in the
    allowed list. Returns (edges(src, dst, label_idx), rejects) -- a label outside the
    list is an error in the reference; here its rows are returned as rejects."""
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(label).alias("label"))
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))
    both = both.withColumn("label_idx", _index_of("label", allowed_labels))
    return (both.filter(F.col("label_idx").isNotNull()).select("src", "dst", "label_idx"),
            both.filter(F.col("label_idx").isNull()))


def _labelled(df: DataFrame, vocab: Mapping[str, Sequence], cols: Sequence[str]) -> DataFrame:
    """Every label of a composite (column -> allowed values) as its index, and ``reason``: the
    label columns whose value is not allowed, null if all are."""
    found = {f"{c}_idx": _index_of(c, allowed) for c, allowed in vocab.items()}
    reason = F.concat_ws(",", *[F.when(v.isNull(), F.lit(c)) for (c, v) in zip(vocab, found.values())])
    return df.withColumn("reason", F.when(reason != "", reason)).select(
        *cols, *[v.alias(k) for k, v in found.items()], *vocab, "reason")


def labelled_graph(nodes: DataFrame, bonds: DataFrame, node_vocab: Mapping[str, Sequence], bond_vocab: Mapping[str, Sequence],
                   node_id: str = "node_id", src: str = "src", dst: str = "dst") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """C10 with node tables and composite labels, such as (number, chirality) of a node and (type,
    direction) of a bond: (nodes, edges, node rejects, bond rejects).

    ``node_vocab`` and ``bond_vocab`` map each label column to its allowed values; labels become
    ``<column>_idx``, the index in that list. Every bond is listed in both directions. A node
    with a label outside its list is a reject, with the offending columns in ``reason``; so is
    a bond, also if an end of it is no accepted node ("src", "dst"). Null labels are outside
    any list. Repeated nodes and bonds stay. The bonds meet the accepted ids in one join per end.
    """
    n = _labelled(nodes.withColumnRenamed(node_id, "node_id"), node_vocab, ["node_id"])
    good, bad = n.filter("reason is null"), n.filter("reason is not null")
    ids = good.select(F.col("node_id").alias("__id")).distinct()
    b = _labelled(bonds.withColumnRenamed(src, "src").withColumnRenamed(dst, "dst"), bond_vocab, ["src", "dst"])
    for end in ("src", "dst"):
        b = b.join(ids.withColumnRenamed("__id", f"__{end}"), F.col(end) == F.col(f"__{end}"), "left")
    ends = [F.when(F.col(f"__{end}").isNull(), F.lit(end)) for end in ("src", "dst")]
    reason = F.concat_ws(",", "reason", *ends)
    b = cut_lineage(b.withColumn("reason", F.when(reason != "", reason)).drop("__src", "__dst"))
    idx = [f"{c}_idx" for c in bond_vocab]
    edges = b.filter("reason is null")
    both = edges.select("src", "dst", *idx).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *idx))
    return (good.select("node_id", *[f"{c}_idx" for c in node_vocab]), both, bad.select("node_id", *node_vocab, "reason"),
            b.filter("reason is not null").select("src", "dst", *bond_vocab, "reason"))


def _with_self_loops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    loops = nodes.select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"),
                         F.lit(SELF_LOOP_LABEL).alias("label_idx"))
    return edges.select("src", "dst", "label_idx").unionByName(loops)


def _edge_emb(edge_emb: Sequence, dtype: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v).cast(dtype) for v in edge_emb]), F.col("label_idx") + 1)


# ------------------------------------------------------------------ C11
def gcn_propagate(nodes: DataFrame, edges: DataFrame, edge_emb: Sequence[float]) -> DataFrame:
    """C11: one GCN step with self loops and symmetric normalisation:
    x'_i = sum_{j->i} d_j^-1/2 d_i^-1/2 (x_j + e_label), degrees counted on the source
    side including the self loop (a zero degree gives weight 0)."""
    e = _with_self_loops(nodes, edges)
    deg = e.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    inv = deg.select(F.col("src").alias("node_id"),
                     F.when(F.col("deg") > 0, F.lit(1.0) / F.sqrt("deg")).otherwise(F.lit(0.0)).alias("dinv"))
    j = (e.join(nodes.select(F.col("node_id").alias("src"), "x"), "src")
         .join(inv.select(F.col("node_id").alias("src"), F.col("dinv").alias("d_src")), "src")
         .join(inv.select(F.col("node_id").alias("dst"), F.col("dinv").alias("d_dst")), "dst"))
    msg = F.col("d_src") * F.col("d_dst") * (F.col("x") + _edge_emb(edge_emb, "double"))
    return j.groupBy(F.col("dst").alias("node_id")).agg(F.sum(msg).alias("x"))


# ------------------------------------------------------------------ C12
def gin_propagate(nodes: DataFrame, edges: DataFrame, edge_emb: Sequence[float], k: int = 5,
                  decimal: str | None = "decimal(38,6)") -> DataFrame:
    """K GIN rounds, x'_i = sum_{j->i, self loop included} (x_j + e_label), ReLU after
    every round but the last. With ``decimal`` the sums are fixed-point, hence exact and
    independent of partitioning and summation order; ``None`` keeps doubles."""
    dtype = decimal or "double"
    e = cut_lineage(_with_self_loops(nodes, edges))
    x = nodes.select("node_id", F.col("x").cast(dtype).alias("x"))
    for r in range(k):
        agg = (e.join(x.withColumnRenamed("node_id", "src"), "src")
               .groupBy(F.col("dst").alias("node_id"))
               .agg(F.sum(F.col("x") + _edge_emb(edge_emb, dtype)).cast(dtype).alias("x")))
        if r < k - 1:
            agg = agg.withColumn("x", F.greatest(F.col("x"), F.lit(0).cast(dtype)))
        x = cut_lineage(agg)
    return x
