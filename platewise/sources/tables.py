"""Readers and writers for the supplied tables and for result tables (A1, A10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One supplied parquet table; Catalyst prunes columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_candidates(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    fmt: str = "parquet", id_col: str = "candidate_id",
                    order_cols: list[str] | None = None) -> DataFrame:
    """A1: load a candidate table with a declared schema and a stable integer id.

    When the table carries no id, one is derived from ``order_cols`` (a natural key)
    with ``xxhash64`` so that it is stable across re-reads and does not depend on
    file split order; ``monotonically_increasing_id`` would change between runs.
    """
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(path)
    if id_col not in df.columns:
        if not order_cols:
            raise ValueError(f"no '{id_col}' column and no natural key given to derive it")
        df = df.withColumn(id_col, F.xxhash64(*order_cols))
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """A10: write a result table. Partitioning by plate/data path gives partition pruning later."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
