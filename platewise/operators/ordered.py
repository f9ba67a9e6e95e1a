"""Order-dependent helpers that stay skew-safe.

A plain ``Window.partitionBy(group).orderBy(...)`` sends a whole group to one task.
When one run or one language holds a third of all rows that task becomes the job.
The helpers here split every group into blocks of a monotone block key (a time
bucket or ``id div B``): the exact work happens inside (group, block) partitions,
and only one summary row per block crosses block boundaries, so the widest
window touches ``rows / B`` rows instead of all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _struct_of(order_cols: list[str], value: Column | str, name: str = "_v") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.struct(*[F.col(c) for c in order_cols], v.alias(name))


def last_non_null_struct(value: Column | str, order_cols: list[str]) -> Column:
    """Aggregate: the (order..., value) struct of the last row with non-null value."""
    v = F.col(value) if isinstance(value, str) else value
    return F.max(F.when(v.isNotNull(), _struct_of(order_cols, v)))


def first_non_null(value: Column | str, order_cols: list[str]) -> Column:
    """Aggregate: value of the first row (by order) whose value is non-null.

    ``min`` over a struct is a fixed-size partial aggregate, so hot groups are
    combined map-side before the shuffle.
    """
    v = F.col(value) if isinstance(value, str) else value
    return F.min(F.when(v.isNotNull(), _struct_of(order_cols, v)))["_v"]


def ffill_blocked(df: DataFrame, group_cols: list[str], order_cols: list[str],
                  block: Column, value_col: str, out_col: str) -> DataFrame:
    """Forward-fill ``value_col`` within each group, in ``order_cols`` order.

    ``block`` must be non-decreasing along the order (e.g. an hour bucket of the
    timestamp, or ``id div 100000``).
    """
    blk = "__blk"
    d = df.withColumn(blk, block)
    keys = group_cols + [blk]
    per_block = d.groupBy(*keys).agg(last_non_null_struct(value_col, order_cols).alias("__last"))
    carry_w = (Window.partitionBy(*group_cols).orderBy(blk)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_block.select(
        *keys, F.last("__last", ignorenulls=True).over(carry_w)["_v"].alias("__carry"))
    inner_w = (Window.partitionBy(*keys).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (d.join(carry, keys, "left")
            .withColumn(out_col, F.coalesce(F.last(value_col, ignorenulls=True).over(inner_w),
                                            F.col("__carry")))
            .drop(blk, "__carry"))


def next_in_group(df: DataFrame, group_cols: list[str], order_col: str, block_size: int,
                  out_col: str) -> DataFrame:
    """Attach the next ``order_col`` value of the same group (a skew-safe ``lead``)."""
    blk = "__blk"
    d = df.withColumn(blk, F.floor(F.col(order_col) / F.lit(block_size)))
    keys = group_cols + [blk]
    heads = d.groupBy(*keys).agg(F.min(order_col).alias("__head"))
    nxt_w = Window.partitionBy(*group_cols).orderBy(blk)
    heads = heads.select(*keys, F.lead("__head").over(nxt_w).alias("__next_head"))
    inner_w = Window.partitionBy(*keys).orderBy(order_col)
    return (d.join(heads, keys, "left")
            .withColumn(out_col, F.coalesce(F.lead(order_col).over(inner_w), F.col("__next_head")))
            .drop(blk, "__next_head"))


def running_max_blocked(df: DataFrame, group_cols: list[str], order_cols: list[str],
                        block: Column, value_col: str, out_col: str) -> DataFrame:
    """Running maximum of ``value_col`` per group along the order (nulls ignored), skew-safe."""
    blk = "__blk"
    d = df.withColumn(blk, block)
    keys = group_cols + [blk]
    per_block = d.groupBy(*keys).agg(F.max(value_col).alias("__bmax"))
    carry_w = (Window.partitionBy(*group_cols).orderBy(blk)
               .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_block.select(*keys, F.max("__bmax").over(carry_w).alias("__carry"))
    inner_w = (Window.partitionBy(*keys).orderBy(*order_cols)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = F.max(value_col).over(inner_w)
    return (d.join(carry, keys, "left")
            .withColumn(out_col, F.when(F.col("__carry").isNull(), inner)
                        .when(inner.isNull(), F.col("__carry"))
                        .otherwise(F.greatest(inner, F.col("__carry"))))
            .drop(blk, "__carry"))


def global_rank(df: DataFrame, order_cols: list[Column | str], n_parts: int | None = None,
                out_col: str = "rank") -> DataFrame:
    """Exact 0-based global rank along ``order_cols`` without a single-partition window.

    Rows are range-partitioned on the order (the trailing tie-break columns let the
    sampled bounds split a hot value) and sorted inside each partition; the
    partition id and in-partition position are read off
    ``monotonically_increasing_id``. That layout is checkpointed once, so the
    partition sizes and the rows come from the same materialisation (a range
    exchange re-run on shuffled input may sample different bounds). The small
    (partition -> size) table gives the offsets, joined back by broadcast.
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    laid = _laid_out(df, cols, n)
    sizes = laid.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offs = sizes.select("__pid", F.sum("__n").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)).alias("__off"))
    return (laid.join(F.broadcast(offs), "__pid")
            .withColumn(out_col, F.coalesce(F.col("__off"), F.lit(0)) + F.col("__local"))
            .drop("__mid", "__pid", "__local", "__off"))


def _laid_out(df: DataFrame, cols: list[Column], n: int) -> DataFrame:
    from platewise.session import cut_lineage

    laid = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
            .withColumn("__mid", F.monotonically_increasing_id()))
    return cut_lineage(laid.withColumn("__pid", F.shiftright("__mid", 33))
                       .withColumn("__local", F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))))


def global_cumsum(df: DataFrame, order_cols: list[Column | str], weights: list[str],
                  group_cols: list[str] = (), n_parts: int | None = None, suffix: str = "_before") -> DataFrame:
    """Exclusive running sums of ``weights`` along ``order_cols`` (restarting at every
    ``group_cols`` value, which must lead ``order_cols``), without a window over a group.

    Same layout as ``global_rank``: range partitions, per-partition totals turned into
    offsets on a tiny table, and a running sum inside each (bounded) range partition.
    A group restart subtracts the group's first running value (one small aggregate).
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    laid = _laid_out(df, cols, n)
    tot = laid.groupBy("__pid").agg(*[F.sum(w).alias(f"__t_{w}") for w in weights])
    ow = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select("__pid", *[F.coalesce(F.sum(f"__t_{w}").over(ow), F.lit(0)).alias(f"__o_{w}") for w in weights])
    inner = Window.partitionBy("__pid").orderBy("__local").rowsBetween(Window.unboundedPreceding, -1)
    out = laid.join(F.broadcast(offs), "__pid")
    for w in weights:
        out = out.withColumn(f"{w}{suffix}", F.col(f"__o_{w}") + F.coalesce(F.sum(w).over(inner), F.lit(0)))
    out = out.drop("__mid", "__pid", "__local", *[f"__o_{w}" for w in weights])
    if group_cols:
        starts = small_side(out.groupBy(*group_cols).agg(*[F.min(f"{w}{suffix}").alias(f"__s_{w}") for w in weights]))
        out = out.join(starts, list(group_cols))
        for w in weights:
            out = out.withColumn(f"{w}{suffix}", F.col(f"{w}{suffix}") - F.col(f"__s_{w}")).drop(f"__s_{w}")
    return out


def small_side(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A per-group table as the build side of a join: counted first, broadcast up to ``rows``
    rows, left to a shuffled (and skew-split) join beyond."""
    from platewise.session import cut_lineage

    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def grouped_quantiles(df: DataFrame, by: list[str], value: str, qs: list[float]) -> DataFrame:
    """Exact per-group quantiles with linear interpolation (Spark's ``percentile`` rule),
    long form (by..., q, value).

    Equal values of a group are counted first (combined map-side), so a hot value is one row;
    running counts over the distinct values locate the two order statistics around
    q*(n-1), and one aggregate per group picks them. No group is held by one task."""
    d = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    counted = d.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c"))
    run = global_cumsum(counted, [*by, value], ["__c"], group_cols=by)
    total = small_side(counted.groupBy(*by).agg(F.sum("__c").alias("__n")))
    run = run.join(total, by)
    picks = []
    for i, x in enumerate(qs):
        pos = F.lit(float(x)) * (F.col("__n") - 1)
        for name, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            here = (F.col("__c_before") <= at) & (at < F.col("__c_before") + F.col("__c"))
            picks.append(F.max(F.when(here, F.col(value).cast("double"))).alias(f"__{name}{i}"))
    g = run.groupBy(*by, "__n").agg(*picks)
    long = g.select(*by, "__n", F.explode(F.array(*[F.struct(
        F.lit(float(x)).alias("q"), F.col(f"__lo{i}").alias("x_lo"), F.col(f"__hi{i}").alias("x_hi"))
        for i, x in enumerate(qs)])).alias("s")).select(*by, "__n", "s.*")
    pos = F.col("q") * (F.col("__n") - 1)
    lo, hi = F.floor(pos), F.ceil(pos)
    val = F.when(lo == hi, F.col("x_lo")).otherwise((hi - pos) * F.col("x_lo") + (pos - lo) * F.col("x_hi"))
    return long.select(*by, "q", val.alias("value"))


def position_blocks(df: DataFrame, group_cols: list[str], order_cols: list[str], rows: int = 65_536) -> DataFrame:
    """Adds ``__pos_block``: blocks of ``rows`` consecutive rows along (group, order), whatever
    the spacing of the order values, so block summaries are ``rows`` times fewer than rows."""
    ranked = global_rank(df, [*group_cols, *order_cols], out_col="__pos")
    return ranked.withColumn("__pos_block", F.floor(F.col("__pos") / F.lit(rows))).drop("__pos")


def place_in_groups(df: DataFrame, by: list[str], order_cols: list[str]) -> DataFrame:
    """Adds ``__g`` (one number per group, null keys included), ``__n`` (rows of the group) and
    ``__place`` (position within it along ``order_cols``, from 0), without a window over a group."""
    rank = global_rank(df, [*by, *order_cols], out_col="__rank")
    groups = rank.groupBy(*by).agg(F.min("__rank").alias("__g"), F.count(F.lit(1)).alias("__n"))
    if by:
        keys = [F.col(c).alias(f"__b{k}") for k, c in enumerate(by)]
        same = reduce(lambda x, y: x & y, [F.col(f"__b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)])
        rank = rank.join(small_side(groups.select(*keys, "__g", "__n")), same).drop(*[f"__b{k}" for k in range(len(by))])
    else:
        g = groups.first() or {"__g": 0, "__n": 0}  # an empty table has no group
        rank = rank.withColumn("__g", F.lit(g["__g"]).cast("bigint")).withColumn("__n", F.lit(g["__n"]).cast("bigint"))
    return rank.withColumn("__place", F.col("__rank") - F.col("__g")).drop("__rank")
