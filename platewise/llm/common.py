"""Shared pieces of the ``llm`` operators: staging, hashing, ASCII folding, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.session import ensure_checkpoint_dir

#: The white space of every contract here: space and the five controls U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RE = r"[\x20\x09-\x0D]"
WORD_RE = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage, so a lost executor recomputes at most one step; fixes row numbers and
    partition-dependent ids once; and lets Spark see the true size of the table.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete the folder of a staged table that a later one has replaced."""
    spark = df.sparkSession
    top = ensure_checkpoint_dir(spark).rstrip("/")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("llm-") and path.getParent().toUri().getPath() == spark._jvm.org.apache.hadoop.fs.Path(
                top).toUri().getPath():
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash128(col: Column, seed: int = 1) -> list[Column]:
    """Two 64-bit hashes under different seeds, as columns ``h1`` and ``h2``."""
    return [F.xxhash64(col).alias("h1"), F.xxhash64(F.lit(seed), col).alias("h2")]


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z alone. Text of one-byte characters takes the fast built-in."""
    return (F.when(F.octet_length(col) == F.char_length(col), F.lower(col))
            .otherwise(F.translate(col, UPPER, LOWER)))


def crc_mod(id_col: Column, m: int) -> Column:
    """crc32 of the id as text, mod ``m``; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % m, F.lit(0))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, root) for every node in ``edges``.

    Contraction by random priorities: every node hooks to the neighbour with the smallest
    hash, if that is below its own; edges are rewritten to the hooked ends and equal ones
    collapse. Any graph, long paths included, loses a constant share of its nodes per round,
    so the rounds grow with the logarithm of the size. Hot ends are safe: the neighbour
    choice is a map-side combined minimum and the rewriting joins read staged tables, which
    adaptive execution splits when skewed. ``root`` is some node of the component.
    """
    def pri(c: str) -> Column:
        return F.struct(F.xxhash64(F.col(c)).alias("p"), F.col(c).alias("n"))

    e = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct())
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = stage(both.groupBy("u").agg(F.min(pri("v")).alias("m"))
                     .select("u", F.when(F.col("m") < pri("u"), F.col("m.n")).otherwise(F.col("u")).alias("up")))
        hooks.append(hook)
        e = stage(e.join(hook, "u").select(F.col("up").alias("x"), "v")
                  .join(hook.withColumnRenamed("u", "v"), "v").select(F.col("x").alias("u"), F.col("up").alias("v"))
                  .filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    if not hooks:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("root")).limit(0)
    # nodes that vanished in round i point to a node of round i + 1; resolve from the last round back
    root = hooks[-1].select(F.col("u").alias("node"), F.col("up").alias("root"))
    for hook in reversed(hooks[:-1]):
        nxt = root.withColumnRenamed("node", "up")
        root = stage(hook.join(nxt, "up", "left").select(F.col("u").alias("node"), F.coalesce("root", "up").alias("root")))
    return root
