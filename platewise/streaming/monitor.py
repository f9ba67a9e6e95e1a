"""Live form of the loop's logged metrics (L1).

The state is one row per run (max suggestion, latest acquisition sum), so no
watermark is needed while run ids are bounded; add ``withWatermark`` plus a
state TTL when they are not. Results go to a table in the shared folder through
``foreachBatch`` (idempotent overwrite of the small state), not to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def monitor(stream: DataFrame, run_col: str = "run_id", order_cols: tuple[str, ...] = ("ts", "event_id"),
            suggestion: str = "suggestion", acq_sum: str = "acq_sum") -> DataFrame:
    """L1: per run, best suggestion so far and the latest logged acquisition sum."""
    latest_key = F.when(F.col(acq_sum).isNotNull(), F.struct(*[F.col(c) for c in order_cols]))
    return stream.groupBy(run_col).agg(
        F.max(suggestion).alias("best_so_far"),
        F.max_by(acq_sum, latest_key).alias("latest_acq_sum"),
        F.count(F.lit(1)).alias("n_logged"))


def run_available(spark: SparkSession, stream: DataFrame, table_path: str, checkpoint: str) -> DataFrame:
    """Drain everything available (``availableNow``) in complete mode into ``table_path``."""

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(table_path)

    q = (stream.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(table_path)
