"""The training-data pipeline: five stages over ``documents``, each one operator of ``platewise.llm``.

Every stage works on all rows that the stage before kept, and writes them as Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import crc_mod, read, stage
from platewise.llm.hyper_lang import UNKNOWN, identify, learn_prototypes
from platewise.llm.line_dedup import dedup_lines
from platewise.llm.mixing import mix_sources
from platewise.llm.packing import pack
from platewise.llm.setsketch import near_groups


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised. Prototypes are learnt from the labelled
    rows outside the held-out quarter; rejected are texts without letters."""
    learn = docs.filter(crc_mod(F.col("doc_id"), 4) != 2)
    found = identify(docs, learn_prototypes(learn))
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that a document of smaller id holds already."""
    out = dedup_lines(docs)
    return _counted(out, docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _by_row(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Each distinct (doc_id, text) of ``docs`` once, with the columns of ``found`` (_id, _th, ...).

    Plain key columns, so the join and the removal of repeated rows share one shuffle.
    """
    def keyed(df: DataFrame, id_col: str) -> DataFrame:
        return df.withColumn("_k", F.coalesce(F.col(id_col), F.lit(0))).withColumn("_n", F.col(id_col).isNull())

    rows = keyed(docs.withColumn("_th", F.xxhash64("text")), "doc_id")
    return rows.join(keyed(found, "_id").drop("_id"), ["_k", "_n", "_th"]).dropDuplicates(["_k", "_n", "_th"])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id, of repeated rows one."""
    kept = near_groups(docs).filter("kept").select(F.col("id").alias("_id"), F.col("th").alias("_th")).distinct()
    return _by_row(docs, stage(kept)).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    taken = mix_sources(docs).filter("copies > 0").groupBy(F.col("id").alias("_id"), F.col("text_hash").alias("_th"))
    out = _by_row(docs, stage(taken.agg(F.sum("copies").cast("int").alias("_copies"))))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece of a document."""
    out = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                      "sequence_id", "offset", "source", "window")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mixing", mixing), ("packing", packing)]
#: Learnt prototypes and tokenizer ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages from ``documents`` to packed pieces; each but the last is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs)
    return docs
