"""Results tables: filter, group, best configuration, describe, format.

Everything here is one or two aggregations over the runs table. Best-of
selections use two fully partial aggregates (max of the value, then min of the
key struct among rows that reach it) instead of a window over all groups, so a
hot configuration or metric never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.functions.moments import stddev_samp
from platewise.operators.ordered import global_rank, small_side


# ------------------------------------------------------------------ B1
def filter_by_dict(df: DataFrame, base: Mapping, extra: Mapping | None = None) -> DataFrame:
    """B1: conjunction of ``col == v`` (scalar) or ``col IN (...)`` (list); null never matches.

    The caller's dictionaries are not modified. One ``filter`` is emitted, so the
    whole predicate reaches the parquet scan.
    """
    conds = dict(base)
    if extra:
        conds.update(extra)
    if not conds:
        return df
    preds = []
    for k, v in conds.items():
        c = F.col(f"`{k}`")
        preds.append(c.isin(list(v)) if isinstance(v, (list, tuple, set)) else c == F.lit(v))
    return df.filter(reduce(lambda a, b: a & b, preds))


# ------------------------------------------------------------------ B7
def distinct_levels(df: DataFrame, col: str, order_col: str) -> DataFrame:
    """Distinct values of ``col`` in order of first appearance, as (level, first_pos, level_rank)."""
    firsts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.min(order_col).alias("first_pos"))
    return global_rank(firsts, ["first_pos", col]).withColumn("level_rank", F.col("rank") + 1).drop("rank")


# ------------------------------------------------------------------ J2
@dataclass(frozen=True)
class Hits:
    """What a hit count counts: rows among the ``best`` ones, or rows above ``percentile``."""

    best: int | None = None
    percentile: int | None = None

    def possible(self, plate_rows: int) -> int:
        """The most hits there can be on a plate of that many rows (a part of a row does not count)."""
        if self.best is not None:
            return self.best
        return plate_rows * (100 - self.percentile) // 100


def counts_to_share(df: DataFrame, metrics: Mapping[str, Hits], plate_rows: int = 720) -> DataFrame:
    """The named hit counts -> share of the possible hits; other columns stay."""
    return df.withColumns({name: F.col(name).cast("double") / F.lit(float(hits.possible(plate_rows)))
                           for name, hits in metrics.items()})


# ------------------------------------------------------------------ J3
def group_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean of each metric per key combination; rows with a null key are dropped."""
    keep = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) if keys else F.lit(True)
    return df.filter(keep).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def _best_rows(means: DataFrame, part_cols: Sequence[str], key_cols: Sequence[str],
               value_col: str) -> DataFrame:
    """Per ``part_cols``: the row with the highest value; ties -> smallest key tuple.

    Null values are skipped. Two partial aggregates + one equi-join, no window.
    """
    valid = means.filter(F.col(value_col).isNotNull() & ~F.isnan(value_col))
    top = valid.groupBy(*part_cols).agg(F.max(value_col).alias("__top"))
    at_top = valid.join(top, list(part_cols)).filter(F.col(value_col) == F.col("__top"))
    if not key_cols:
        return top.withColumnRenamed("__top", value_col)
    pick = at_top.groupBy(*part_cols).agg(
        F.min(F.struct(*[F.col(k) for k in key_cols])).alias("__k"), F.max("__top").alias(value_col))
    return pick.select(*part_cols, *[F.col("__k")[k].alias(k) for k in key_cols], value_col)


# ------------------------------------------------------------------ J4
def best_config(df: DataFrame, analysis_col: str, metrics: Sequence[str],
                config_cols: Sequence[str], filters: Mapping | None = None) -> DataFrame:
    """For each metric, the (analysis value, config) group with the highest mean.

    Returns one row per metric: ``metric, <analysis_col>, <config_cols>, value``.
    All metrics are handled in one aggregation + unpivot.
    """
    d = filter_by_dict(df, filters) if filters else df
    keys = [analysis_col] + list(config_cols)
    means = group_means(d, keys, metrics)
    long = means.unpivot(keys, list(metrics), "metric", "value")
    return _best_rows(long, ["metric"], keys, "value").select("metric", *keys, "value")


# ------------------------------------------------------------------ J5
def best_config_runs(df: DataFrame, base: Mapping, main_metric: str, category: str,
                     config_cols: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per category, the best configuration by the main metric; keep only its runs.

    ``config_cols`` maps each category value to the configuration columns that
    matter for it (an empty list keeps every run of that category). Columns that do
    not matter for a category are masked to null and compared null-safely, so one
    grouped aggregate and one semi-join replace the reference's loop of filters.
    """
    cats = list(config_cols)
    all_cols = sorted({c for cols in config_cols.values() for c in cols})
    d = filter_by_dict(df, base, {category: cats})

    def relevant(c: str) -> Column:
        users = [k for k, cols in config_cols.items() if c in cols]
        return F.col(category).isin(users) if users else F.lit(False)

    masked = {f"__m_{c}": F.when(relevant(c), F.col(c)) for c in all_cols}
    d = d.withColumns(masked)
    # a relevant config column that is null drops the row (pandas groupby/filter semantics)
    complete = reduce(lambda a, b: a & b,
                      [~relevant(c) | F.col(c).isNotNull() for c in all_cols], F.lit(True))
    d = d.filter(complete)
    mkeys = list(masked)
    means = d.groupBy(category, *mkeys).agg(F.avg(main_metric).alias("__mean"))
    best = _best_rows(means, [category], mkeys, "__mean").select(category, *mkeys)
    best = small_side(best.select(*[F.col(c).alias(f"__best_{c}") for c in [category, *mkeys]]))  # a row per category
    cond = reduce(lambda a, b: a & b, [F.col(category) == F.col(f"__best_{category}")]
                  + [F.col(k).eqNullSafe(F.col(f"__best_{k}")) for k in mkeys])
    return d.join(best, cond, "left_semi").drop(*mkeys)


# ------------------------------------------------------------------ J6 / J7
def describe_by(df: DataFrame, by: Sequence[str], metrics: Sequence[str],
                exact: bool = True, accuracy: int = 100_000) -> DataFrame:
    """Count, mean, sample sd, min, 25/50/75 % (linear interpolation), max per group.

    ``exact=True`` locates the exact order statistics with one distributed rank per
    metric; ``exact=False`` uses the bounded-memory ``percentile_approx`` sketch.
    """
    from platewise.operators.ordered import grouped_quantiles

    by = list(by)
    d = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by]))
    aggs = []
    for m in metrics:
        c = F.col(m)
        aggs += [F.count(c).alias(f"{m}_count"), F.avg(c).alias(f"{m}_mean"),
                 stddev_samp(c).alias(f"{m}_std"), F.min(c).cast("double").alias(f"{m}_min"),
                 F.max(c).cast("double").alias(f"{m}_max")]
        if not exact:
            aggs.append(F.percentile_approx(c, [0.25, 0.5, 0.75], accuracy).cast("array<double>").alias(f"__{m}_q"))
    out = d.groupBy(*by).agg(*aggs)
    for m in metrics:
        if exact:  # distributed exact order statistics (no group held by one task)
            q = grouped_quantiles(d, by, m, [0.25, 0.5, 0.75])
            wide = q.groupBy(*by).agg(*[F.max(F.when(F.col("q") == v, F.col("value"))).alias(f"{m}_{s}")
                                        for v, s in ((0.25, "25"), (0.5, "50"), (0.75, "75"))])
            out = out.join(wide, by, "left")
        else:
            out = out.withColumns({f"{m}_25": F.col(f"__{m}_q")[0], f"{m}_50": F.col(f"__{m}_q")[1],
                                   f"{m}_75": F.col(f"__{m}_q")[2]}).drop(f"__{m}_q")
    return out


def rank_groups(described: DataFrame, by: Sequence[str], main_metric: str) -> DataFrame:
    """Groups ordered by mean of the main metric, descending (nulls last, key tie-break).

    The rank is a column so the order survives any later shuffle. The input is
    one row per group (already aggregated), so the global window is over groups.
    """
    w = Window.orderBy(F.col(f"{main_metric}_mean").desc_nulls_last(), *[F.col(k) for k in by])
    return described.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------------------ J8 / J9
def fmt2(c: Column) -> Column:
    """Two-decimal text (half-up on the decimal form); a missing value prints as ``nan``."""
    return F.when(c.isNull() | F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.2f", c))



def mean_sd_label(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """``mean ± sd`` text with two decimals per group and metric."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), stddev_samp(m).alias(f"{m}_std")]
    g = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])).groupBy(*by).agg(*aggs)
    return g.withColumns({f"{m}_label": F.concat(fmt2(F.col(f"{m}_mean")), F.lit(" ± "), fmt2(F.col(f"{m}_std")))
                          for m in metrics})


def parse_mean(col: Column | str) -> Column:
    """The number before ``±`` of a ``mean ± sd`` label (null when not a number)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.split(c, "±")[0]).try_cast("double")


# ------------------------------------------------------------------ J10
FACTOR_TYPES = (("Kernel", "kernel"), ("Initialisation", "init"), ("Acquisition", "acquisition"))


def factor_table(df: DataFrame, metrics: Sequence[str],
                 factors: Sequence[tuple[str, str]] = FACTOR_TYPES) -> DataFrame:
    """Stacked per-factor ``mean ± sd`` table; the type label only on each block's first row.

    Output: ``type_order, pos, Type, Parameter, <metric labels>`` ordered by the
    fixed type order then mean of the first metric descending.
    """
    parts = []
    for i, (label, col) in enumerate(factors):
        g = mean_sd_label(df, [col], metrics).withColumnRenamed(col, "Parameter")
        parts.append(g.withColumn("type_order", F.lit(i)).withColumn("__type", F.lit(label))
                     .withColumn("Parameter", F.col("Parameter").cast("string")))
    u = reduce(lambda a, b: a.unionByName(b), parts)
    w = Window.partitionBy("type_order").orderBy(F.col(f"{metrics[0]}_mean").desc_nulls_last(), "Parameter")
    u = u.withColumn("pos", F.row_number().over(w))
    return u.select("type_order", "pos",
                    F.when(F.col("pos") == 1, F.col("__type")).otherwise(F.lit("")).alias("Type"),
                    "Parameter", *[F.col(f"{m}_label").alias(m) for m in metrics])


# ------------------------------------------------------------------ J11 / J12
def combo_table(df: DataFrame, cols: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample sd of each metric for every combination of ``cols``."""
    return mean_sd_label(df, cols, metrics)


def group_counts(df: DataFrame, by: Sequence[str], filters: Mapping | None = None) -> DataFrame:
    """Non-null count of every other column per group, after a filter."""
    d = filter_by_dict(df, filters) if filters else df
    others = [c for c in d.columns if c not in by]
    return d.groupBy(*by).agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in others])
