"""Sharding by a k-d tree over document metadata. DataFrame functions throughout.

A node of the tree stands for a run of shards. It is cut at a weighted median along the
metadata dimension in which it is widest, until every leaf is one shard. All dimensions are
measured in the same unit: the place of a value is the number of bytes that the whole corpus
has below it, so a node's width along a dimension is the share of the corpus between its
smallest and its largest value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import stage
from platewise.operators.ordered import global_cumsum, small_side

SIZE = "_octave"


def octave(size: Column) -> Column:
    """Length of a size in bits and its three digits after the first: eight steps from a power of two to the next."""
    bits = F.length(F.bin(size))
    return bits * 8 + F.conv(F.substring(F.rpad(F.bin(size), 4, "0"), 2, 3), 2, 10).cast("int")


def _places(d: DataFrame, dim: str, k: int) -> DataFrame:
    """Adds ``p<k>``: bytes of all documents with a smaller value of ``dim`` (code points, null last)."""
    values = d.groupBy(dim).agg(F.sum("size").alias("w")).withColumn("_null", F.col(dim).isNull())
    run = global_cumsum(values, ["_null", dim], ["w"]).select(F.col(dim).alias("_v"), F.col("w_before").alias(f"p{k}"))
    return d.join(small_side(run), F.col(dim).eqNullSafe(F.col("_v"))).drop("_v")


def assign_shards(docs: DataFrame, shards: int | None = 8, target_bytes: int | None = None, id_col: str = "doc_id",
                  text_col: str = "text", dims: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row per input row: id, size, text_crc32, text_hash, shard, slot, shard_bytes.

    size is the UTF-8 length of the text plus 1. The number of shards is given, or follows
    from ``target_bytes`` a shard. The dimensions are ``dims`` (those that the table has; any
    orderable type, null last) and the size by octave steps. A node of k shards gives k // 2
    of them, and that share of its bytes, to the lower side; a document goes to the side that
    holds its middle byte. Along a cut, rows of one value are lined up by the text's crc32 and
    the id, so equal texts with equal metadata lie together and share a shard unless a cut
    falls among them: shards stay equal in bytes to within one document per cut, however
    large a group of copies is. slot numbers the documents of a shard from 0 in that order.

    Null text counts as empty (size 1, crc32 0). Null ids and repeated rows take places of
    their own; shards beyond the number of rows stay empty. Other columns are ignored; an
    empty table gives an empty one. A rerun gives the same rows.

    Every level is one range partitioning of narrow rows by (node, value, crc32, id, row) with
    per-partition offsets, so no node, value or group of copies is ever held by one task;
    node tables have one row per shard.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text_col).alias("text_hash"),
                    *[F.col(c).alias(f"_d{k}") for k, c in enumerate(dims) if c in docs.columns])
    d = stage(d.withColumn(SIZE, octave(F.col("size"))).withColumn("rid", F.monotonically_increasing_id()))
    names = [*[c for c in d.columns if c.startswith("_d")], SIZE]
    if shards is None:
        total = d.agg(F.sum("size").alias("s")).first()["s"] or 0
        shards = max(1, math.ceil(total / target_bytes))
    for k, c in enumerate(names):
        d = _places(d, c, k)
    places = [f"p{k}" for k in range(len(names))]
    state = d.select("id", "size", "text_crc32", "text_hash", "rid", *places, F.lit(0).alias("node"),
                     F.lit(shards).alias("k"), F.lit(1).cast("bigint").alias("one"))
    big = lambda c: c.cast("decimal(38,0)")
    for _ in range(max(1, math.ceil(math.log2(shards)))):
        widths = [F.max(p) - F.min(p) for p in places]
        nodes = state.groupBy(F.col("node").alias("at")).agg(F.sum("size").alias("bytes"), F.array(*widths).alias("w"))
        nodes = nodes.select("at", "bytes", F.array_position("w", F.array_max("w")).cast("int").alias("along"))
        state = (state.join(small_side(nodes), F.col("node") == F.col("at"))
                 .withColumn("value", F.element_at(F.array(*places), F.col("along"))).drop("at", "along"))
        laid = global_cumsum(state, ["node", "value", "text_crc32", "id", "rid"], ["size", "one"], group_cols=["node"])
        low = F.floor(F.col("k") / 2).cast("int")
        middle = F.col("size_before") * 2 + F.col("size")
        left = (F.col("k") == 1) | (big(middle) * big(F.col("k")) < big(F.col("bytes")) * big(low) * 2)
        state = laid.select("id", "size", "text_crc32", "text_hash", "rid", *places, "one", "one_before",
                            F.when(left, F.col("node")).otherwise(F.col("node") + low).alias("node"),
                            F.when(F.col("k") == 1, F.lit(1)).when(left, low).otherwise(F.col("k") - low).alias("k"))
    leaves = small_side(state.groupBy(F.col("node").alias("shard")).agg(
        F.min("one_before").alias("start"), F.sum("size").alias("shard_bytes")))
    return state.join(leaves, F.col("node") == F.col("shard")).select(
        "id", "size", "text_crc32", "text_hash", "shard", (F.col("one_before") - F.col("start")).alias("slot"), "shard_bytes")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write id and text of every document as Parquet below ``path``/shard=N, by slot, and return the assignment.

    A shard is written by as many tasks as its share of the rows asks for.
    """
    placed = stage(assign_shards(docs, id_col=id_col, text_col=text_col, **options))
    keyed = lambda df: df.withColumn("_k", F.coalesce(F.col("id").cast("string"), F.lit(""))).withColumn(
        "_n", F.col("id").isNull())
    texts = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumn("_h", F.xxhash64("text"))
    texts = texts.dropDuplicates(["_k", "_n", "_h"]).drop("id")
    rows = keyed(placed).withColumn("_h", F.col("text_hash")).join(texts, ["_k", "_n", "_h"])
    (rows.select("shard", "slot", "id", "text", "size").repartitionByRange("shard", "slot")
     .sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path))
    return placed
