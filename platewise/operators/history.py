"""Run histories: collapse logs, paths over epochs, running best, optimum lines."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.operators.ordered import ffill_blocked, first_non_null, position_blocks, running_max_blocked, small_side


# ------------------------------------------------------------------ J1
def collapse_history(hist: DataFrame, run_col: str, order_cols: Sequence[str], epoch_col: str,
                     metrics: Sequence[str], block_rows: int = 65_536) -> DataFrame:
    """Forward-fill the epoch along the log, then one row per (run, epoch) holding the
    first non-null value of every metric. Rows before a run's first epoch fall out, so
    runs without any epoch vanish.

    The fill is block-wise (see ``ordered``) and the per-epoch firsts are partial
    ``min(struct)`` aggregates: one shuffle by (run, block), one by (run, epoch).
    """
    placed = position_blocks(hist, [run_col], list(order_cols), block_rows)
    filled = ffill_blocked(placed, [run_col], list(order_cols), F.col("__pos_block"), epoch_col, "__epoch")
    filled = filled.filter(F.col("__epoch").isNotNull())
    return (filled.groupBy(run_col, F.col("__epoch").alias(epoch_col))
            .agg(*[first_non_null(m, list(order_cols)).alias(m) for m in metrics]))


# ------------------------------------------------------------------ J14
def best_so_far(hist: DataFrame, run_col: str, order_cols: Sequence[str], value_col: str,
                out_col: str = "best_so_far", block_rows: int = 65_536) -> DataFrame:
    """Running maximum of the observed target per run along the log."""
    placed = position_blocks(hist, [run_col], list(order_cols), block_rows)
    return running_max_blocked(placed, [run_col], list(order_cols), F.col("__pos_block"), value_col,
                               out_col).drop("__pos_block")


# ------------------------------------------------------------------ D5 (used by J13)
def rescale_range(df: DataFrame, col: str, lo: float = 0.0, hi: float = 1.0,
                  by: Sequence[str] = (), out_col: str | None = None) -> DataFrame:
    """Min-max of a column onto [lo, hi], globally or per group (constant range -> lo)."""
    out_col = out_col or col
    stats = df.groupBy(*by).agg(F.min(col).alias("__mn"), F.max(col).alias("__mx"))
    if by:  # one row per group, joined by key
        j = df.join(small_side(stats), list(by))
    else:  # one global scalar pair: attached as literals
        r = stats.first()
        j = df.withColumn("__mn", F.lit(r["__mn"])).withColumn("__mx", F.lit(r["__mx"]))
    rng = F.col("__mx") - F.col("__mn")
    scaled = F.when(rng == 0, F.lit(lo)).otherwise(
        F.lit(lo) + (F.col(col) - F.col("__mn")) / rng * F.lit(hi - lo))
    return j.withColumn(out_col, scaled).drop("__mn", "__mx")


# ------------------------------------------------------------------ J13
def bo_paths(collapsed: DataFrame, selection: DataFrame, run_col: str, epoch_col: str,
             metric: str, label_col: str, n_boot: int = 1000, seed: int = 0,
             scale: int | None = None) -> DataFrame:
    """Mean of a metric per (label, epoch) over the selected runs, with a 95 % bootstrap
    interval (resamples as large as their group, see ``stats.bootstrap_ci``)."""
    from platewise.operators.stats import bootstrap_ci

    sel = collapsed.join(selection.select(run_col, label_col), run_col, "inner")
    sel = sel.filter(F.col(metric).isNotNull())
    return bootstrap_ci(sel, [label_col, epoch_col], metric, [run_col], n=n_boot, seed=seed, scale=scale)


# ------------------------------------------------------------------ J15
def global_optimum(runs: DataFrame, path_col: str, target_col: str, order_col: str,
                   n_epochs_col: str) -> DataFrame:
    """Best known target per data set (taken from its first run), on every epoch 0..n-1.

    ``n_epochs_col`` carries the epoch count on every row (a broadcast scalar).
    """
    best = runs.groupBy(path_col).agg(F.min_by(target_col, order_col).alias("optimum"),
                                      F.max(n_epochs_col).cast("bigint").alias("__n"))
    return (best.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1)))
            .select(path_col, "epoch", "optimum"))


# ------------------------------------------------------------------ J16
def mirrored_metric(df: DataFrame, by: Sequence[str], acq_col: str, metric: str,
                    mirrored_value: str = "ei") -> DataFrame:
    """Group means, negated for one acquisition so it plots opposite the other; the
    symmetric axis bound is the largest absolute value (one scalar, broadcast)."""
    keys = list(by) + [acq_col]
    g = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])) \
        .groupBy(*keys).agg(F.avg(metric).alias("mean"))
    g = g.withColumn("value", F.when(F.col(acq_col) == mirrored_value, -F.col("mean"))
                     .otherwise(F.col("mean")))
    bound = g.agg(F.max(F.abs("value"))).first()[0]
    return g.withColumn("bound", F.lit(bound).cast("double"))


# ------------------------------------------------------------------ J17
def suggestions_vs_random(hist: DataFrame, chosen: DataFrame, random_runs: DataFrame,
                          run_col: str, value_col: str) -> DataFrame:
    """Suggested values of the chosen runs against those of random runs, tagged by arm."""
    vals = hist.filter(F.col(value_col).isNotNull())
    a = vals.join(chosen.select(run_col), run_col, "left_semi").withColumn("arm_label", F.lit("chosen"))
    b = vals.join(random_runs.select(run_col), run_col, "left_semi").withColumn("arm_label", F.lit("random"))
    return a.unionByName(b)
