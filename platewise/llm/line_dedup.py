"""Line dedup: lines that several documents share stay in one of them only. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import BLANKS, ascii_lower, hash128, stage


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10,
                min_docs: int = 2) -> DataFrame:
    """All columns of ``docs`` with the text rebuilt, plus n_lines and n_dropped.

    Texts are split at \\n (null or empty: one empty line). A line whose key has at least
    ``min_chars`` code points and is found in at least ``min_docs`` documents stays in the
    smallest id that holds it and goes everywhere else. Within that document all its
    repeats stay. Rows that share an id count as one document; rows without an id count as
    one that comes after all others. Repeated rows are treated alike. Columns of the input
    named n_lines or n_dropped are replaced. An empty table gives an empty one.

    Only (id, position, hash) rows are aggregated: distinct (key, document) pairs first,
    then counts per key, both combined map-side, so a line held by a third of all documents
    is one row per task. Lines find their verdict by a join that adaptive execution splits
    where a key is hot. The text itself moves once, to meet the positions to drop.
    """
    lines = F.split(F.coalesce(F.col("_text"), F.lit("")), "\n", -1)
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
                      F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    src = src.withColumn("_th", F.xxhash64("_text"))
    cand = stage(src.select("_id", "_th", F.posexplode(lines).alias("pos", "line"))
                 .select("_id", "_th", "pos", line_key(F.col("line")).alias("key"))
                 .filter(F.char_length("key") >= min_chars)
                 .select("_id", "_th", "pos", *hash128(F.col("key"))))
    shared = stage(cand.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("one"))
                   .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.min("_id").alias("keeper"))
                   .filter(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"))
    drops = (cand.join(shared, ["h1", "h2"]).filter(~F.col("_id").eqNullSafe(F.col("keeper")))
             .groupBy(F.col("_id").alias("d_id"), F.col("_th").alias("d_th"))
             .agg(F.collect_set("pos").alias("drop")))
    joined = src.join(drops, F.col("_id").eqNullSafe(F.col("d_id")) & (F.col("_th") == F.col("d_th")), "left")
    dropped = F.coalesce(F.col("drop"), F.array().cast("array<int>"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), dropped)
    out = joined.withColumn("_lines", lines)
    cols = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    new_text = F.when(F.col("drop").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(keep, lambda i: F.get("_lines", i)), "\n"))
    return out.select(*cols, new_text.alias(text_col), F.size("_lines").cast("bigint").alias("n_lines"),
                      F.coalesce(F.size("drop").cast("bigint"), F.lit(0).cast("bigint")).alias("n_dropped"))
