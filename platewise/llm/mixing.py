"""Mixing sources to target weights by systematic sampling. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.functions.rand import md5_u32, md5_unit
from platewise.llm.common import WORD_RE, stage
from platewise.operators.ordered import global_rank

SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) rows gain ``target``: ``share`` of all words dealt by weight, no
    source above ``most`` times its size, the excess dealt again by weight until none is.

    ``weights`` repeat over the sources in code point order, a null source last. One scalar
    aggregate per round; a source is full once its ceiling over its weight is below the level.
    """
    ranked = global_rank(sizes.withColumn("_null", F.col("source").isNull()), ["_null", "source"], out_col="_r")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_r") % len(weights) + 1).cast("int"))
    s = stage(ranked.select("source", "source_size", w.alias("w"),
                            (F.col("source_size") * F.lit(float(most))).alias("ceil")))
    goal = s.agg((F.sum("source_size") * F.lit(float(share))).alias("g")).first()["g"] or 0.0
    level, full, rest, weight = -1.0, -1, goal, 1.0
    while True:
        is_full = F.col("ceil") <= F.col("w") * F.lit(level)
        row = s.agg(F.count(F.when(is_full, 1)).alias("n"), F.sum(F.when(is_full, F.col("ceil"))).alias("c"),
                    F.sum(F.when(~is_full, F.col("w"))).alias("w")).first()
        if row["n"] == full or not row["w"]:
            break
        full, rest, weight = row["n"], goal - (row["c"] or 0.0), row["w"]
        level = rest / weight
    target = F.when(F.col("ceil") <= F.col("w") * F.lit(level), F.col("ceil")).otherwise(
        F.lit(rest) * F.col("w") / F.lit(weight))
    return s.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0,
                seed: str = SEED) -> DataFrame:
    """One row per input row: id, text_hash, size (words), source_size, target, copies, taken.

    Every document of a source expects target / source_size copies. Lined up by size, a
    seeded hash of the id and the id, the expected copies are summed from the front and
    shifted by one seeded offset per source; a document is taken once for each integer that
    its stretch of the sum crosses. Lining up by size makes the words taken as even as the
    copies. Runs with one seed agree.

    Null text has size 0; a null source is a source of its own; a source without words gets
    target 0 and takes nothing. Repeated rows and null ids hold places of their own (equal
    rows are interchangeable). Other columns are ignored; an empty table gives an empty one.

    Ranks come from a range partitioning on (source, size, hash, id) with partition offsets,
    so a source with a third of all rows spreads over a third of the partitions.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_RE)), F.lit(0)).cast("bigint")
    d = stage(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                          F.xxhash64(text_col).alias("text_hash"), size.alias("size"))
              .withColumn("h", md5_u32(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    targets = stage(source_targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    ranked = global_rank(d.withColumn("_null", F.col("source").isNull()),
                         ["_null", "source", "size", "h", "id"], out_col="rank")
    start = stage(ranked.groupBy(F.col("source").alias("s_source")).agg(F.min("rank").alias("start")))
    per_source = stage(targets.join(start, F.col("source").eqNullSafe(F.col("s_source")))
                       .select("s_source", "source_size", "target", "start",
                               F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
                               .otherwise(F.lit(0.0)).alias("r"),
                               md5_unit(F.lit(seed), F.coalesce("s_source", F.lit(""))).alias("u")))
    k = F.col("rank") - F.col("start")
    crossed = (F.floor(F.col("r") * (k + 1) + F.col("u")) - F.floor(F.col("r") * k + F.col("u"))).cast("bigint")
    copies = F.least(F.greatest(crossed, F.lit(0)), F.floor(F.lit(float(most))).cast("bigint"))
    return (ranked.join(per_source, F.col("source").eqNullSafe(F.col("s_source")))
            .select("id", "text_hash", "size", "source_size", "target", copies.alias("copies"))
            .withColumn("taken", F.col("copies") * F.col("size")))
