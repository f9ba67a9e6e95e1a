"""Session helpers: a local session for tests/bench, and lineage cutting."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "platewise", shuffle_partitions: int = 8,
                  memory: str = "8g") -> SparkSession:
    """Local session used by tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make reliable checkpoints usable.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value is
    always used when present. Only when the session has none (local tests, the
    local check harness) a scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="platewise-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never a local checkpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewrite(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it back.

    Cuts lineage as ``cut_lineage`` does, and forgets how the rows were partitioned: a loop that
    joins a table with parts of itself would otherwise collect a partitioning per join, which
    the planner multiplies out.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder below the checkpoint folder whose tables nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """SQL settings for the jobs run inside; what was set before comes back afterwards."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def testdata_dir(sf: str = "0.01") -> str:
    return os.environ.get("PLATEWISE_SF_DIR", f"/root/testdata/sf{sf}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-spread rows when a scan yields fewer partitions than the cluster has cores.

    A small table of long texts often sits in one file and one row group, i.e. one
    task; heavy per-row work then runs serially. Large inputs already arrive in
    many splits and are returned untouched (no extra shuffle).
    """
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    # byte-range splits of a file with few row groups leave most splits empty, so a scan
    # with only a few splits per core is rebalanced; wide scans are left as they are
    if df.rdd.getNumPartitions() >= 4 * want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)
