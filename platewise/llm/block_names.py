"""Exact dedup by deterministic block naming.

Every normalised text is cut into blocks of fixed size; the distinct blocks are sorted and
numbered, so equal blocks carry one integer. Then adjacent names are paired and the distinct
pairs are numbered the same way, halving the sequence each round, until every document is
one integer. Two documents share it if and only if their texts are equal: no hash decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BLANK_RE, hash128, stage


def _number(distinct_rows: DataFrame, *keys: str) -> DataFrame:
    """Sorted numbering: the place of each distinct key in its sorted hash partition.

    The partition number sits above the place, so names never meet; the staged table fixes
    them for good.
    """
    return distinct_rows.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def _blocks(binary, size: int):
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(binary) / F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(binary, i * size + 1, F.lit(size)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = 4096) -> DataFrame:
    """One row per input row: id, n_chars (code points of the original), text_sha256 (of the
    text without white space), keep_id, group_size, kept, n_blocks.

    Texts are equal when identical after white space is deleted; of equal ones the longest
    original stays, then the smallest id (a null id comes last), then the first row.
    Null text counts as empty; all empty texts are one group. Repeated rows are separate
    members, of which at most one is kept. Other columns are ignored; an empty table gives
    an empty result.

    The text is shuffled once, in map-side combined form, so a third of all rows with one
    text costs one block per task. Rows find their block's name by a 128-bit hash that the
    table of distinct blocks proves to be one-to-one; if it ever is not, another seed is
    taken. Only integers move after that.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("bigint").alias("n_chars"),
                       F.regexp_replace(text, BLANK_RE, "").cast("binary").alias("bin"))
    distinct = norm.select(F.explode(_blocks(F.col("bin"), block_bytes)).alias("block")).distinct()
    seed, names = 0, None
    while names is None:
        seed += 1
        named = stage(_number(distinct, "block").select(*hash128(F.col("block"), seed), "name"))
        if named.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            names = named
    rows = stage(norm.select(
        F.monotonically_increasing_id().alias("rid"), "id", "n_chars", F.sha2("bin", 256).alias("text_sha256"),
        F.transform(_blocks(F.col("bin"), block_bytes),
                    lambda x: F.struct(*hash128(x, seed))).alias("hs")))

    left = (rows.select("rid", F.size("hs").alias("left"), F.posexplode("hs").alias("pos", "h"))
            .select("rid", "left", "pos", "h.h1", "h.h2"))
    level, done = 0, []
    cur = stage(left.join(names, ["h1", "h2"]).select("rid", "left", "pos", "name"))
    while True:
        done.append(cur.filter("left = 1").select("rid", F.lit(level).alias("level"), "name"))
        cur = cur.filter("left > 1")
        if cur.isEmpty():
            break
        level += 1
        pairs = (cur.groupBy("rid", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.first("left").alias("left"),
                      F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("x"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("y")))
        pair_names = stage(_number(pairs.select("x", "y").distinct(), "x", "y"))
        cur = stage(pairs.join(pair_names, ["x", "y"])
                    .select("rid", F.expr("(left + 1) div 2").cast("int").alias("left"), "pos", "name"))
    identity = done[0]
    for more in done[1:]:
        identity = identity.unionAll(more)

    full = rows.select("rid", "id", "n_chars", "text_sha256", F.size("hs").alias("n_blocks")).join(identity, "rid")
    best = F.min(F.struct((-F.col("n_chars")).alias("longest"), F.col("id").isNull().alias("no_id"),
                          F.col("id").alias("id"), F.col("rid").alias("rid")))
    groups = stage(full.groupBy("level", "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")))
    return (full.join(groups, ["level", "name"])
            .select("id", "n_chars", "text_sha256", F.col("best.id").alias("keep_id"), "group_size",
                    (F.col("rid") == F.col("best.rid")).alias("kept"), "n_blocks"))
