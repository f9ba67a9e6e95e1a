"""Statistics on results tables: bootstrap, rank and t tests, KS, histograms, densities.

Tests are computed from grouped aggregates (counts, sums, rank sums); p-values
come from closed forms evaluated on the few aggregated rows, never from a
collected sample.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.moments import stddev_samp, var_samp
from platewise.functions.normal import two_sided_normal_p
from platewise.functions.rand import TWO32, md5_u32, np_mix_u32
from platewise.operators.ordered import global_cumsum, place_in_groups
from platewise.session import cut_lineage


# ------------------------------------------------------------------ K8
DRAW_BLOCK = 64  # rows of a group whose values travel together; a draw copies its block once
DRAW_CHUNK = 1 << 20  # rows of a group whose places are drawn together
DRAW_SPAN = 256  # blocks whose rows are drawn together
DRAW_PARTS = 16  # ranges of replicates that the chunks of a group of many rows are dealt to
DRAW_CELLS = 1 << 22  # counts that a task holds before it hands them on
DRAWN_AT_ONCE = 1 << 18


def _votes(n: int):
    """Arrow function of one chunk (one row: g, n, part, parts, hashes) that draws a place per row and replicate
    and gives the counts per block: (g, span, r0, k, counts of k replicates from r0 on)."""
    def votes(t: pa.Table) -> pa.Table:
        out = []
        for g, total, part, parts, h in zip(*[t.column(c) for c in ("__g", "__n", "__part", "__parts", "__hs")]):
            g, total, part, parts = (v.as_py() for v in (g, total, part, parts))
            h = h.values.to_numpy(zero_copy_only=False).astype(np.int64) + (1 << 31)
            last, blocks = (part + 1) * n // parts, -(-total // DRAW_BLOCK)
            step = max(1, DRAW_CELLS // blocks)  # by the group alone, so the counts of its chunks fit together
            for r0 in range(part * n // parts, last, step):
                k = min(step, last - r0)
                counts = np.zeros((k, blocks), np.int64)
                at_once = max(1, DRAWN_AT_ONCE // len(h))
                for s in range(0, k, at_once):
                    reps = np.arange(r0 + s, r0 + min(k, s + at_once), dtype=np.int64)
                    place = (np_mix_u32(h[None], reps[:, None]) / float(TWO32) * total).astype(np.int64) // DRAW_BLOCK
                    place += np.arange(len(reps))[:, None] * blocks
                    counts[s:s + len(reps)] = np.bincount(place.ravel(), minlength=len(reps) * blocks).reshape(-1, blocks)
                kind = np.uint16 if counts.max() < 1 << 16 else np.uint64
                for s in range(0, blocks, DRAW_SPAN):
                    out.append((g, s // DRAW_SPAN, r0, k, counts[:, s:s + DRAW_SPAN].astype(kind).tobytes()))
        cols = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, kinds)], names=["__g", "__span", "r0", "k", "counts"])

    return votes


def _span_draws(seed: int, g: int, span: int, m: int, votes: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(replicates, draws of each, positions drawn among the m rows of a span), some replicates at a time."""
    sizes = np.full(-(-m // DRAW_BLOCK), DRAW_BLOCK, np.int64)
    sizes[-1] = m - DRAW_BLOCK * (len(sizes) - 1)
    first = np.arange(len(sizes)) * DRAW_BLOCK
    names = [f"{seed}:{g}:{span * DRAW_SPAN + b}:" for b in range(len(sizes))]
    given: dict[int, np.ndarray] = {}
    for r0, k, raw in zip(*[votes.column(c) for c in ("r0", "k", "counts")]):
        raw, k = raw.as_py(), k.as_py()
        c = np.frombuffer(raw, np.uint16 if len(raw) == 2 * k * len(sizes) else np.uint64).astype(np.int64).reshape(k, -1)
        given[r0.as_py()] = given[r0.as_py()] + c if r0.as_py() in given else c
    for r0 in sorted(given):
        at_once = max(1, DRAWN_AT_ONCE // m)
        for s in range(0, len(given[r0]), at_once):
            c = given[r0][s:s + at_once]
            reps = np.arange(r0 + s, r0 + s + len(c))
            own = np.fromiter((int.from_bytes(md5(f"{b}{r}".encode()).digest()[:4], "big") for r in reps.tolist() for b in names),
                              np.int64, c.size)
            flat = c.ravel()
            cell = np.repeat(np.arange(len(flat)), flat)
            j = np.arange(1, len(cell) + 1) - np.repeat(np.cumsum(flat) - flat, flat)
            block = cell % len(sizes)
            at = (np_mix_u32(own[cell], j) / float(TWO32) * sizes[block]).astype(np.int64) + first[block]
            yield reps, c.sum(1), at


def _drawn(df: DataFrame, by: Sequence[str], value: str, id_cols: Sequence[str], n: int, seed: int,
           out: Callable[[pa.Array, Iterator], list[pa.Array]], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``out`` per span of a group, preceded by __g; (by..., __g)). ``out`` gets the span's values and its draws."""
    by = list(by)
    d = df.select(*by, F.col(value).alias("__v"), md5_u32(F.lit(str(seed)), *[F.col(c) for c in id_cols]).alias("__h"),
                  *[F.col(c).alias(f"__i{k}") for k, c in enumerate(id_cols)])
    rank = place_in_groups(d, by, [f"__i{k}" for k in range(len(id_cols))])
    part = lambda rows, name: F.floor(F.col("__place") / F.lit(rows)).cast("bigint").alias(name)
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    parts = F.when(F.col("__n") > DRAW_BLOCK * DRAW_SPAN // 4, F.lit(min(DRAW_PARTS, n))).otherwise(F.lit(1))
    chunks = rank.groupBy("__g", "__n", part(DRAW_CHUNK, "__chunk")).agg(
        F.collect_list((F.col("__h") - F.lit(1 << 31)).cast("int")).alias("__hs"))
    chunks = chunks.withColumn("__parts", parts).withColumn("__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    votes = chunks.repartition(tasks, "__g", "__chunk", "__part").groupBy("__g", "__chunk", "__part").applyInArrow(
        _votes(n), "__g long, __span long, r0 int, k int, counts binary")
    spans = rank.groupBy("__g", part(DRAW_BLOCK * DRAW_SPAN, "__span")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("__place").alias("p"), "__v"))), lambda x: x["__v"]).alias("__values"))

    names = [c.strip().split()[0] for c in schema.split(",")]

    def draw(values: pa.Table, counts: pa.Table) -> pa.Table:
        g, span = values.column("__g")[0].as_py(), values.column("__span")[0].as_py()
        v = values.column("__values")[0].values
        cols = out(v, _span_draws(seed, g, span, len(v), counts))
        return pa.table([pa.array(np.full(len(cols[0]), g)), *cols], names=["__g", *names])

    key = ["__g", "__span"]
    drawn = (spans.repartition(tasks, *key).groupBy(*key).cogroup(votes.repartition(tasks, *key).groupBy(*key))
             .applyInArrow(draw, f"__g long, {schema}"))
    return drawn, rank.select(*by, "__g").distinct()


def resamples(df: DataFrame, by: Sequence[str], value: str, id_cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """(by..., rep, value): n resamples with replacement of every group, each exactly as large as the group.

    A draw is made in two steps. Every row of a group draws a place in its group for each
    replicate, of which only the block of ``DRAW_BLOCK`` places is kept: the counts per
    (group, replicate, block) are multinomial and add up to the size of the group. A task counts
    the draws of ``DRAW_CHUNK`` rows, so what is shuffled are counts, not draws. Each block then
    draws as many of its own rows as it was given, ``DRAW_SPAN`` blocks in a task. A hot group is as
    many chunks and spans as it needs. Draws are hashes of the ids: reruns agree.
    """
    def rows(v: pa.Array, draws: Iterator) -> list[pa.Array]:
        got = [(np.repeat(reps, c), at) for reps, c, at in draws]
        return [pa.array(np.concatenate([r for r, _ in got]).astype(np.int32)), v.take(pa.array(np.concatenate([at for _, at in got])))]

    kind = df.select(F.col(value).alias("v")).schema["v"].dataType.simpleString()
    drawn, groups = _drawn(df, by, value, id_cols, n, seed, rows, f"rep int, __value {kind}")
    return _named(drawn, groups, by).select(*by, "rep", F.col("__value").alias(value))


def resample_totals(df: DataFrame, by: Sequence[str], value: str, id_cols: Sequence[str], n: int, seed: int) -> DataFrame:
    """(by..., rep, total, n): sums of the ``resamples`` and their sizes. Sums are taken where a span's rows are
    drawn, so no drawn row leaves its task; whole numbers are summed as longs, others as doubles."""
    whole = df.select(F.col(value).alias("v")).schema["v"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    kind = "bigint" if whole else "double"

    def totals(v: pa.Array, draws: Iterator) -> list[pa.Array]:
        x = v.to_numpy(zero_copy_only=False)
        big = max(abs(int(x.max())), abs(int(x.min()))) if whole else 0
        got = []
        for reps, c, at in draws:
            drawn = x[at] if big * int(c.max()) < 1 << 63 else x[at].astype(object)  # object: exact, and an error beyond a long
            s, some = np.zeros(len(reps), drawn.dtype), c > 0
            s[some] = np.add.reduceat(drawn, (np.cumsum(c) - c)[some]) if some.any() else 0
            got.append((reps, s, c))
        reps, s, c = (np.concatenate([p[i] for p in got]) for i in range(3))
        return [pa.array(reps.astype(np.int32)), pa.array(s, pa.int64() if whole else pa.float64()), pa.array(c)]

    d = df.select(*by, *[c for c in id_cols if c not in by and c != value], F.col(value).cast(kind).alias("__x"),
                  *([value] if value in id_cols and value not in by else []))
    drawn, groups = _drawn(d, by, "__x", id_cols, n, seed, totals, "rep int, s " + kind + ", c long")
    sums = drawn.groupBy("__g", "rep").agg(F.sum("s").alias("total"), F.sum("c").alias("n"))
    return _named(sums, groups, by).select(*by, "rep", "total", "n")


def _named(drawn: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    return drawn.join(groups, "__g") if by else drawn


def bootstrap_ci(df: DataFrame, by: Sequence[str], metric: str, id_cols: Sequence[str],
                 n: int = 1000, seed: int = 0, level: float = 0.95, scale: int | None = None) -> DataFrame:
    """K8: group mean with a percentile bootstrap interval (linear interpolation); a replicate
    is as large as its group. Null values are left out.

    ``scale``: when the metric is fixed-point with that many decimals (prices, cents),
    sums are accumulated exactly as integers, so the replicate means do not depend on
    summation order.
    """
    by = list(by)
    df = df.filter(F.col(metric).isNotNull())
    base = df.groupBy(*by).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n"))
    src = df.select(*by, *[c for c in id_cols if c not in by], metric)
    if scale is not None:  # integer units once per input row, not once per draw
        src = src.withColumn(metric, F.round(F.col(metric) * F.lit(10 ** scale)).cast("bigint"))
    mean = F.col("total") / (F.col("n") * F.lit(1.0 if scale is None else float(10 ** scale)))
    per_rep = resample_totals(src, by, metric, id_cols, n, seed).select(*by, "rep", mean.alias("m"))
    lo, hi = (1 - level) / 2, 1 - (1 - level) / 2
    ci = per_rep.groupBy(*by).agg(F.percentile("m", [lo, hi]).alias("__ci"))
    if not by:
        c = ci.first()["__ci"] or [None, None]
        return base.select("mean", "n", F.lit(c[0]).cast("double").alias("ci_lo"), F.lit(c[1]).cast("double").alias("ci_hi"))
    ci = ci.select(*[F.col(c).alias(f"__b{k}") for k, c in enumerate(by)], "__ci")
    on = reduce(lambda x, y: x & y, [F.col(f"__b{k}").eqNullSafe(F.col(c)) for k, c in enumerate(by)])
    return base.join(ci, on, "left").select(*by, "mean", "n", F.col("__ci")[0].alias("ci_lo"),
                                            F.col("__ci")[1].alias("ci_hi"))


# ------------------------------------------------------------------ Student t (Welch p)
def _betainc_cf(a, b, x, iters: int = 300):
    """Regularised incomplete beta I_x(a, b) (numpy, vectorised; Lentz continued fraction)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    out = np.full(x.shape, np.nan)
    ok = np.isfinite(a) & np.isfinite(b) & np.isfinite(x) & (a > 0) & (b > 0)
    out[ok & (x <= 0)] = 0.0
    out[ok & (x >= 1)] = 1.0
    m = ok & (x > 0) & (x < 1)
    if not m.any():
        return out
    a_, b_, x_ = a[m], b[m], x[m]
    swap = x_ > (a_ + 1) / (a_ + b_ + 2)
    aa, bb, xx = np.where(swap, b_, a_), np.where(swap, a_, b_), np.where(swap, 1 - x_, x_)
    lgam = np.vectorize(math.lgamma)
    lbeta = lgam(aa) + lgam(bb) - lgam(aa + bb)
    front = np.exp(aa * np.log(xx) + bb * np.log1p(-xx) - lbeta) / aa
    tiny = 1e-300
    c = np.ones_like(xx)
    d = 1 - (aa + bb) * xx / (aa + 1)
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1 / d
    f = d.copy()
    for i in range(1, iters + 1):
        num = i * (bb - i) * xx / ((aa + 2 * i - 1) * (aa + 2 * i))
        d = 1 + num * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1 + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1 / d
        f = f * c * d
        num = -(aa + i) * (aa + bb + i) * xx / ((aa + 2 * i) * (aa + 2 * i + 1))
        d = 1 + num * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1 + num / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1 / d
        delta = c * d
        f = f * delta
        if np.all(np.abs(delta - 1) < 1e-15):
            break
    res = front * f
    out[m] = np.where(swap, 1 - res, res)
    return out


def student_t_two_sided_p(t, df):
    """Two-sided Student-t p-value, I_{df/(df+t^2)}(df/2, 1/2), vectorised."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    return _betainc_cf(df / 2.0, np.full_like(df, 0.5), df / (df + t * t))


def _welch_p_batch(tt: pd.Series, dd: pd.Series) -> pd.Series:
    return pd.Series(student_t_two_sided_p(tt.to_numpy(), dd.to_numpy()))


def welch_p(t: Column, dof: Column) -> Column:
    """Column: Welch two-sided p (Arrow-batched pandas UDF, runs on aggregated rows only)."""
    return F.pandas_udf(_welch_p_batch, "double")(t, dof)


# ------------------------------------------------------------------ exact p of the rank tests (K1, K6)
EXACT_U = 8  # rows of the smaller level up to which the U distribution is counted out
EXACT_AREA = 1e7  # product of both sizes up to which that is done; beyond, the steps of U are below 1e-6 of its range
EXACT_KS = 10_000  # rows of the larger sample up to which the paths of D are counted out


def u_distribution(m: int, n: int) -> np.ndarray:
    """P(U = 0), P(U = 1), ... up to the middle, for samples of m and n rows without ties.

    The number of arrangements with U = u is that of partitions of u into at most m parts of at
    most n, the coefficients of prod (1 - q^(n + i)) / (1 - q^i); each factor is taken as a
    share of all arrangements, so nothing overflows.
    """
    m, n = min(m, n), max(m, n)
    half = m * n // 2 + 1
    c = np.zeros(half)
    c[0] = 1.0
    for i in range(1, m + 1):
        c[n + i:] -= c[:max(0, half - n - i)].copy()
        for r in range(i):
            c[r::i] = np.cumsum(c[r::i])
        c *= i / (n + i)
    return np.maximum(c, 0.0)


def _rank_sum_p_batch(m: pd.Series, n: pd.Series, u: pd.Series) -> pd.Series:
    known: dict[tuple[int, int], np.ndarray] = {}
    out = np.full(len(u), np.nan)
    for k, (a, b, top) in enumerate(zip(m, n, u)):
        if not (0 < min(a, b) <= EXACT_U and a * b <= EXACT_AREA):
            continue
        key = (int(min(a, b)), int(max(a, b)))
        if key not in known:
            known[key] = np.cumsum(u_distribution(*key))
        low = int(round(a * b - top))  # the two tails mirror each other
        out[k] = min(1.0, 2.0 * known[key][min(low, len(known[key]) - 1)])
    return pd.Series(out)


def rank_sum_p(m: Column, n: Column, u: Column) -> Column:
    """Exact two-sided p of the larger U (Arrow-batched, on aggregated rows only)."""
    return F.pandas_udf(_rank_sum_p_batch, "double")(m, n, u)


def ks_outside(m: int, n: int, d: float) -> float:
    """P(D >= d) for samples of m and n rows: the share of lattice paths from (0, 0) to (m, n)
    that touch |i / m - j / n| >= d. All orders of the pooled rows are equally likely, so the
    path comes to (i, j) from (i - 1, j) with probability i / (i + j); diagonal by diagonal."""
    if m > n:
        m, n = n, m
    edge = round(d * m * n) if abs(d * m * n - round(d * m * n)) < 1e-6 * max(1.0, d * m * n) else d * m * n
    i = np.arange(m + 1, dtype=np.float64)
    p = np.zeros(m + 1)
    p[0] = float(edge <= 0)
    for k in range(1, m + n + 1):
        lo, hi = max(0, k - n), min(m, k)
        up = np.empty(hi - lo + 1)
        left = np.concatenate(([0.0], p))[lo:hi + 1]  # from (i - 1, j)
        ii = i[lo:hi + 1]
        up = (ii * left + (k - ii) * p[lo:hi + 1]) / k
        out = np.abs(ii * n - (k - ii) * m) >= edge
        p[lo:hi + 1] = np.where(out, 1.0, up)
    return float(min(1.0, p[m]))


def _ks_p_batch(m: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([ks_outside(int(a), int(b), float(x)) if 0 < max(a, b) <= EXACT_KS and min(a, b) > 0 else np.nan
                      for a, b, x in zip(m, n, d)], dtype="float64")


def ks_exact_p(m: Column, n: Column, d: Column) -> Column:
    """Exact two-sided p of D (Arrow-batched, on aggregated rows only)."""
    return F.pandas_udf(_ks_p_batch, "double")(m, n, d)


# ------------------------------------------------------------------ K2 / K3 / K4
PAIR_BUCKETS = 32  # each level meets a bucket of partners per task, so one group's pairs spread


PART_ROWS = 250_000  # rows of both levels of all pairs that one task counts, sorts and sums


def _pair_parts(pairs: DataFrame) -> int:
    """Tasks for the value counts of all pairs: at least the session's, and more with the rows."""
    least = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-(pairs.agg(F.sum(F.col("na") + F.col("nb"))).first()[0] or 0) // PART_ROWS))


def pairwise_levels(df: DataFrame, param: str, metric: str, order_col: str,
                    keys: Sequence[str] = (), with_p: bool = True) -> DataFrame:
    """K3 (and K4 with ``keys``): Mann-Whitney U and Welch t for every unordered pair of
    levels (i < j in order of first appearance) of ``param``, inside each ``keys`` group.

    Per-level moments and per-(level, value) counts are partial aggregates; the
    pairs come from a self-join of the level table, dealt over buckets of partners (any
    number of levels); rank sums come from the pooled value counts of each pair.
    p_mwu is exact where the smaller level has at most 8 rows and no value is tied, the
    normal form otherwise.
    """
    user_keys = list(keys)
    keys = user_keys or ["__all"]  # one constant group key instead of a key-less (cross) join
    d = df.filter(F.col(param).isNotNull() & F.col(metric).isNotNull() & ~F.isnan(metric))
    d = d.withColumn(param, F.col(param).cast("string"))
    if not user_keys:
        d = d.withColumn("__all", F.lit(0))
    mom = d.groupBy(*keys, param).agg(F.count(metric).alias("n"), F.avg(metric).alias("m"),
                                      var_samp(metric).alias("v"), F.struct(F.min(order_col), F.col(param)).alias("first"))
    mom = cut_lineage(mom)
    a = mom.select(*keys, F.col(param).alias("level_a"), F.col("first").alias("ia"), F.col("n").alias("na"),
                   F.col("m").alias("ma"), F.col("v").alias("va"),
                   F.explode(F.sequence(F.lit(0), F.lit(PAIR_BUCKETS - 1))).alias("__bucket"))
    b = mom.select(*keys, F.col(param).alias("level_b"), F.col("first").alias("ib"), F.col("n").alias("nb"),
                   F.col("m").alias("mb"), F.col("v").alias("vb"),
                   F.pmod(F.xxhash64(param), F.lit(PAIR_BUCKETS)).cast("int").alias("__bucket"))
    pairs = a.join(b, [*keys, "__bucket"]).filter(F.col("ia") < F.col("ib")).drop("__bucket")
    sa, sb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    # two constant levels have no t statistic: null
    pairs = pairs.withColumn("t", F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(sa + sb))) \
        .withColumn("dof", F.try_divide((sa + sb) * (sa + sb), F.try_divide(sa * sa, F.col("na") - 1)
                                        + F.try_divide(sb * sb, F.col("nb") - 1)))
    # Mann-Whitney from pooled value counts of each pair
    n_parts = _pair_parts(pairs)
    vc = d.select(*keys, param, metric).repartition(n_parts, *keys, param, metric).groupBy(*keys, param, metric).agg(
        F.count(F.lit(1)).alias("c"))
    pk = pairs.select(*keys, "level_a", "level_b")
    side_a = vc.join(pk.withColumnRenamed("level_a", param), keys + [param]) \
        .select(*keys, F.col(param).alias("level_a"), "level_b", metric, F.col("c").alias("ca"), F.lit(0).cast("bigint").alias("cb"))
    side_b = vc.join(pk.withColumnRenamed("level_b", param), keys + [param]) \
        .select(*keys, "level_a", F.col(param).alias("level_b"), metric, F.lit(0).cast("bigint").alias("ca"), F.col("c").alias("cb"))
    pv = side_a.unionByName(side_b).repartition(n_parts, *keys, "level_a", "level_b", metric).groupBy(*keys, "level_a", "level_b", metric) \
        .agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    tcount = F.col("ca") + F.col("cb")
    pv = pv.withColumn("__t", tcount)
    pv = global_cumsum(pv, [*keys, "level_a", "level_b", metric], ["__t"],
                       group_cols=[*keys, "level_a", "level_b"], n_parts=n_parts).withColumnRenamed("__t_before", "below")
    rank = F.col("below") + (tcount + F.lit(1)) / F.lit(2.0)
    ties = tcount.cast("double")  # the cube of a large tie has no room in 64 bits
    rs = pv.groupBy(*keys, "level_a", "level_b").agg(
        F.sum(F.col("ca") * rank).alias("r_a"),
        F.sum(ties * ties * ties - ties).alias("tie"))
    out = pairs.join(rs, keys + ["level_a", "level_b"])
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    n = na + nb
    u1 = F.col("r_a") - na * (na + F.lit(1.0)) / F.lit(2.0)
    u = F.greatest(u1, na * nb - u1)
    sigma = F.sqrt(na * nb / F.lit(12.0) * ((n + F.lit(1.0)) - F.col("tie") / (n * (n - F.lit(1.0)))))
    z = (u - na * nb / F.lit(2.0) - F.lit(0.5)) / sigma
    exact = (F.least(na, nb) <= EXACT_U) & (F.col("tie") == 0) & (na * nb <= EXACT_AREA)
    out = out.withColumn("u", u1).withColumn("z", F.when(sigma > 0, z)) \
        .withColumn("p_mwu", F.when(exact, rank_sum_p(na, nb, u)).when(sigma > 0, two_sided_normal_p(F.col("z"))))
    out = out.withColumn("comparison", F.concat_ws(" vs ", "level_a", "level_b"))
    cols = [*user_keys, "comparison", "level_a", "level_b", F.col("na").alias("n_a"), F.col("nb").alias("n_b"),
            "u", "z", "p_mwu", "t", F.col("dof").alias("df")]
    if with_p:
        cols.append(welch_p(F.col("t"), F.col("dof")).alias("p_ttest"))
    return out.select(*cols)


def significant_only(tests: DataFrame, alpha: float = 0.05, p_cols: Sequence[str] = ("p_mwu", "p_ttest")) -> DataFrame:
    """K5: keep comparisons where any p-value is below alpha."""
    cond = None
    for c in p_cols:
        e = F.coalesce(F.col(c) < F.lit(alpha), F.lit(False))
        cond = e if cond is None else cond | e
    return tests.filter(cond)


# ------------------------------------------------------------------ K6 / K7
def kolmogorov_p(d: Column, en: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample KS p: 2 * sum_k (-1)^(k-1) exp(-2 k^2 lambda^2), capped to [0, 1]."""
    lam = (F.sqrt(en) + F.lit(0.12) + F.lit(0.11) / F.sqrt(en)) * d
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
                    lambda acc, k: acc + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
                    * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(2.0) * s))


def ks_two_sample(df: DataFrame, arm_col: str, value_col: str, arm_a, arm_b,
                  by: Sequence[str] = (), weight_col: str | None = None, exact: bool | None = None) -> DataFrame:
    """K6: D = max |F_a - F_b| over the pooled distinct values, and its p.

    p counts lattice paths where the larger sample has at most 10,000 rows and is the
    asymptotic series beyond; ``exact`` False always takes the series, True leaves p null beyond.

    Counts (or weights) are first aggregated per distinct value, so the running
    sums walk distinct values only.
    """
    by = list(by)
    w = F.col(weight_col) if weight_col else F.lit(1)
    d = df.filter(F.col(value_col).isNotNull() & F.col(arm_col).isin(arm_a, arm_b))
    vc = d.groupBy(*by, value_col).agg(
        F.sum(F.when(F.col(arm_col) == arm_a, w).otherwise(0)).cast("double").alias("ca"),
        F.sum(F.when(F.col(arm_col) == arm_b, w).otherwise(0)).cast("double").alias("cb"))
    # running sums over the distinct values with the distributed cumulative sum (no window
    # holding all values of a group); group totals are one small aggregate
    vc = global_cumsum(vc, [*by, value_col], ["ca", "cb"], group_cols=by)
    if by:
        tot = vc.groupBy(*by).agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
        vc = vc.join(tot, by)
    else:
        t = vc.agg(F.sum("ca"), F.sum("cb")).first()
        vc = vc.withColumn("na", F.lit(t[0])).withColumn("nb", F.lit(t[1]))
    fa = (F.col("ca_before") + F.col("ca")) / F.col("na")
    fb = (F.col("cb_before") + F.col("cb")) / F.col("nb")
    vc = vc.withColumn("gap", F.abs(fa - fb))
    g = vc.groupBy(*by).agg(F.max("gap").alias("d"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))
    en = F.col("n_a") * F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    series = kolmogorov_p(F.col("d"), en)
    if exact is False:
        return g.withColumn("p", series)
    # rows go to the counting only where it applies; the others keep the series
    counted = F.greatest("n_a", "n_b") <= EXACT_KS
    size = lambda c: F.when(counted, F.col(c)).otherwise(F.lit(0.0))
    return (cut_lineage(g).withColumn("__e", ks_exact_p(size("n_a"), size("n_b"), F.coalesce("d", F.lit(0.0))))
            .withColumn("p", F.when(counted, F.col("__e")).otherwise(F.lit(None) if exact else series)).drop("__e"))


def ks_bootstrap(df: DataFrame, arm_col: str, value_col: str, arm_a, arm_b, id_cols: Sequence[str],
                 n: int = 100, seed: int = 0, exact: bool | None = None) -> DataFrame:
    """K7: mean KS distance and p over n resamples, each arm as large as it is (rep as a key).
    p as in ``ks_two_sample``."""
    d = df.filter(F.col(value_col).isNotNull() & F.col(arm_col).isin(arm_a, arm_b)).select(
        arm_col, value_col, *[c for c in id_cols if c not in (arm_col, value_col)])
    reps = resamples(d, [arm_col], value_col, list(id_cols), n, seed)
    per = ks_two_sample(reps, arm_col, value_col, arm_a, arm_b, by=["rep"], exact=exact)
    return per.agg(F.avg("d").alias("mean_d"), F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("reps"))


# ------------------------------------------------------------------ K9 / K10
def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """K9: equal-width bins over [min, max]; the maximum falls in the last bin."""
    r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = r["lo"], r["hi"]
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, count bigint")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((F.col(col) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                         (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


def kde_curve(df: DataFrame, col: str, grid: int = 200, bw_adjust: float = 1.5) -> DataFrame:
    """Gaussian KDE on ``grid`` points spanning [min, max] (cut = 0), Scott bandwidth
    sd * n^(-1/5) * bw_adjust. Exact: every distinct value (with its count) adds to every
    grid point inside its own task; grid sums are partial aggregates."""
    d = df.filter(F.col(col).isNotNull())
    r = d.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), stddev_samp(col).alias("sd"),
              F.count(col).alias("n")).first()
    spark = df.sparkSession
    if not r["n"] or not r["sd"]:  # a constant has no curve
        return spark.createDataFrame([], "point int, x double, density double")
    lo, hi, sd, n = r["lo"], r["hi"], r["sd"], r["n"]
    h = sd * n ** (-0.2) * bw_adjust
    step = (hi - lo) / (grid - 1)
    vc = d.groupBy(col).agg(F.count(F.lit(1)).alias("c"))
    gx = F.transform(F.sequence(F.lit(0), F.lit(grid - 1)), lambda i: F.lit(lo) + i * F.lit(step))
    contrib = vc.select(F.posexplode(F.transform(gx, lambda x: F.col("c") * F.exp(
        F.lit(-0.5) * ((x - F.col(col)) / F.lit(h)) * ((x - F.col(col)) / F.lit(h))))).alias("point", "k"))
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    return contrib.groupBy("point").agg((F.sum("k") * F.lit(norm)).alias("density")) \
        .select("point", (F.lit(lo) + F.col("point") * F.lit(step)).alias("x"), "density")


# ------------------------------------------------------------------ K11 / K12
def box_stats(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Quartiles, 1.5*IQR whiskers (extreme values inside the fences) and mean per group."""
    from platewise.operators.ordered import grouped_quantiles, small_side

    by = list(by)
    d = df.filter(F.col(metric).isNotNull())
    qs = grouped_quantiles(d, by, metric, [0.25, 0.5, 0.75]).groupBy(*by).agg(
        *[F.max(F.when(F.col("q") == v, F.col("value"))).alias(a)
          for v, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    q = small_side(d.groupBy(*by).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n")).join(qs, by))
    iqr = F.col("q3") - F.col("q1")
    j = d.join(q, by)
    inside = (F.col(metric) >= F.col("q1") - F.lit(1.5) * iqr) & (F.col(metric) <= F.col("q3") + F.lit(1.5) * iqr)
    wh = j.filter(inside).groupBy(*by).agg(F.min(metric).cast("double").alias("whisker_lo"),
                                           F.max(metric).cast("double").alias("whisker_hi"))
    return q.join(wh, by)


def mean_sd_by_level(df: DataFrame, params: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean and sample sd per metric and level (of one or two parameters)."""
    params = list(params)
    long = df.select(*params, *metrics).unpivot(params, list(metrics), "metric", "value")
    return long.filter(F.col("value").isNotNull()).groupBy("metric", *params).agg(
        F.avg("value").alias("mean"), stddev_samp("value").alias("sd"), F.count("value").alias("n"))
