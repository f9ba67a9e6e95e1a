"""Constant columns, exact p-values and resamples, against enumeration."""

import itertools
import math
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions.rand import np_mix_u32
from platewise.operators import metrics as H
from platewise.operators import scale as D
from platewise.operators import stats as K


# ---- constants, however the rows are split -----------------------------------------
@pytest.mark.parametrize("parts", [4, 5, 8])
def test_constant_columns_have_no_spread(spark, parts):
    df = spark.range(0, 1_100_000, 1, parts).select(
        "id", F.lit(0.1).alias("y"), F.lit(0.3).alias("mu"), F.lit(1.0).alias("var"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.array(F.lit(0.7)).alias("features"))
    assert H.regression_scores(df).first()["r2"] is None
    assert [r["r2"] for r in H.tail_scores(df, ["id"]).collect()] == [None] * 3
    stats = H.target_stats(df).first()
    assert stats["target_stat_std"] == 0.0 and stats["target_stat_var"] == 0.0
    assert K.kde_curve(df, "y").count() == 0
    assert D.fit_scale(df)["scale"] == [1.0]
    _, _, sd = D.standardize_outcome(df)
    assert sd == 1.0
    pair = K.pairwise_levels(df, "g", "y", "id").first()
    assert pair["t"] is None and pair["df"] is None and pair["p_ttest"] is None and pair["z"] is None
    assert K.mean_sd_by_level(df, ["g"], ["y"]).agg(F.max("sd")).first()[0] == 0.0


def test_spread_of_few_rows_and_nan(spark):
    from platewise.functions.moments import stddev_samp, var_pop, var_samp

    one = spark.createDataFrame([(1.0,)], "v double").agg(var_samp("v"), var_pop("v"), stddev_samp("v")).first()
    assert one[0] is None and one[1] == 0.0 and one[2] is None
    none = spark.createDataFrame([(None,)], "v double").agg(var_samp("v"), var_pop("v")).first()
    assert none[0] is None and none[1] is None
    nan = spark.createDataFrame([(float("nan"),)] * 3, "v double").agg(var_samp("v")).first()
    assert math.isnan(nan[0])
    two = spark.createDataFrame([(1.0,), (3.0,), (None,)], "v double").agg(var_samp("v"), var_pop("v")).first()
    assert two[0] == 2.0 and two[1] == 1.0


# ---- exact p -----------------------------------------------------------------------
@pytest.mark.parametrize("m,n", [(1, 1), (1, 6), (3, 4), (5, 5), (2, 9), (7, 6)])
def test_rank_sum_distribution_equals_enumeration(m, n):
    count = {}
    for c in itertools.combinations(range(m + n), m):
        u = sum(x - i for i, x in enumerate(c))
        count[u] = count.get(u, 0) + 1
    total = math.comb(m + n, m)
    want = [count.get(u, 0) / total for u in range(m * n // 2 + 1)]
    assert np.allclose(K.u_distribution(m, n), want, atol=1e-14)
    for u, top in itertools.product(range(m * n + 1), [None]):
        larger = max(u, m * n - u)
        p = min(1.0, 2 * sum(c for v, c in count.items() if v >= larger) / total)
        assert abs(K._rank_sum_p_batch([m], [n], [float(larger)])[0] - p) < 1e-12


@pytest.mark.parametrize("m,n", [(1, 1), (3, 4), (5, 5), (2, 8), (6, 4)])
def test_ks_paths_equal_enumeration(m, n):
    reach = {}
    for c in itertools.combinations(range(m + n), m):
        i = top = 0
        for k in range(1, m + n + 1):
            i += (k - 1) in c
            top = max(top, abs(i * n - (k - i) * m))
        reach[top] = reach.get(top, 0) + 1
    for edge in range(m * n + 1):
        want = sum(c for t, c in reach.items() if t >= edge) / math.comb(m + n, m)
        assert abs(K.ks_outside(m, n, edge / (m * n)) - want) < 1e-12


def test_small_levels_take_the_exact_p(spark):
    a, b = [1.0, 2.5, 7.0, 9.0], [3.0, 4.0, 8.0, 10.0, 11.0]
    rows = [(i, "a", v) for i, v in enumerate(a)] + [(10 + i, "b", v) for i, v in enumerate(b)] + [(20, "c", 1.0), (21, "c", 4.0)]
    got = {r["comparison"]: r for r in K.pairwise_levels(spark.createDataFrame(rows, "id long, g string, v double"), "g", "v", "id").collect()}
    u = sum(x > y for x in a for y in b)
    wins = [sum(x > y for x in s for y in set(a + b) - set(s)) for s in map(set, itertools.combinations(a + b, 4))]
    top = max(u, 20 - u)
    assert got["a vs b"]["u"] == u and abs(got["a vs b"]["p_mwu"] - 2 * sum(w >= top for w in wins) / len(wins)) < 1e-12
    tied = got["a vs c"]  # 1.0 is tied: the normal form
    assert abs(tied["p_mwu"] - math.erfc(abs(tied["z"]) / math.sqrt(2))) < 1e-6


def test_many_levels_need_no_list_of_pairs(spark):
    df = spark.range(1200).select("id", (F.col("id") % 300).cast("string").alias("g"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    out = K.pairwise_levels(df, "g", "v", "id", with_p=False)
    assert out.count() == 300 * 299 // 2
    first = out.filter("level_a = '0' and level_b = '1'").first()
    assert first["n_a"] == 4 and first["n_b"] == 4
    assert out.filter("cast(level_a as int) >= cast(level_b as int)").count() == 0  # by first appearance


def test_ks_series_beyond_the_counted_sizes(spark):
    df = spark.range(30_000).select((F.col("id") % 2).alias("arm"), (F.col("id") * 31 % 9973).cast("double").alias("v"))
    auto, series = (K.ks_two_sample(df, "arm", "v", 0, 1, exact=e).first() for e in (None, False))
    assert auto["p"] == series["p"] and K.ks_two_sample(df, "arm", "v", 0, 1, exact=True).first()["p"] is None


# ---- resamples ---------------------------------------------------------------------
def test_resamples_are_as_large_as_their_group(spark):
    sizes = {"a": 1, "b": 700, None: 3500}
    rows = [(k, i, float(i)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    out = K.resamples(df, ["g"], "v", ["id"], 20, 5).cache()
    per = {(r["g"], r["rep"]): (r["n"], r["lo"], r["hi"], r["mean"]) for r in out.groupBy("g", "rep").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean")).collect()}
    assert len(per) == 60 and all(v[0] == sizes[g] for (g, _), v in per.items())
    assert all(v[1] >= 0 and v[2] < sizes[g] for (g, _), v in per.items())
    # a row is left out of a resample with probability 1/e, and the means scatter as sd / sqrt(n)
    left = 1 - out.filter("g = 'b'").select("rep", "v").distinct().count() / (20 * 700)
    assert abs(left - math.exp(-1)) < 0.02
    means = [v[3] for (g, _), v in per.items() if g is None]
    assert abs(np.std(means) / (3500 / math.sqrt(12) / math.sqrt(3500)) - 1) < 0.6 and len(set(means)) == 20
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert key(out) == key(K.resamples(df.repartition(7), ["g"], "v", ["id"], 20, 5))


def test_bootstrap_without_groups_and_without_rows(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("v"))
    r = K.bootstrap_ci(df, [], "v", ["id"], n=200).first()
    assert r["mean"] == 24.5 and r["n"] == 50 and 15 < r["ci_lo"] < 24.5 < r["ci_hi"] < 34
    assert K.bootstrap_ci(df.filter("id < 0").withColumn("g", F.lit(1)), ["g"], "v", ["id"], n=10).count() == 0


def _drawn_by_hand(seed, n, ids):
    """Per replicate, the positions of ids (in order) that the rule of ``resamples`` draws, for a group that comes first."""
    u32 = lambda *p: int(md5(":".join(map(str, p)).encode()).hexdigest()[:8], 16)
    mix = lambda h, r: int(np_mix_u32(np.int64(h), np.int64(r)))
    for rep in range(n):
        votes = Counter(mix(u32(seed, i), rep) * len(ids) // 2**32 // 64 for i in ids)
        yield rep, sorted(64 * b + mix(u32(seed, 0, b, rep), j) * min(64, len(ids) - 64 * b) // 2**32
                          for b, c in votes.items() for j in range(1, c + 1))


def test_resample_totals_are_summed_where_rows_are_drawn(spark, monkeypatch):
    monkeypatch.setattr(K, "DRAW_CHUNK", 7000)  # three chunks and two spans
    ids = list(range(3, 3 + 20_000))
    df = spark.createDataFrame([(None, i, 7 * i, float(i) / 3) for i in ids], "g string, id long, w long, v double")
    totals = {r["rep"]: (r["g"], r["total"], r["n"]) for r in K.resample_totals(df, ["g"], "w", ["id"], 3, 5).collect()}
    floats = {r["rep"]: r["total"] for r in K.resample_totals(df, ["g"], "v", ["id"], 3, 5).collect()}
    rows = {}
    for r in K.resamples(df, ["g"], "id", ["id"], 3, 5).collect():
        rows.setdefault(r["rep"], []).append(r["id"])
    for rep, at in _drawn_by_hand(5, 3, ids):
        assert sorted(rows[rep]) == [ids[k] for k in at]
        assert totals[rep] == (None, sum(7 * ids[k] for k in at), 20_000)
        assert abs(floats[rep] - sum(ids[k] / 3 for k in at)) < 1e-3


def test_resamples_keep_nulls_and_other_types_and_totals_beyond_a_long_fail(spark):
    df = spark.createDataFrame([(1, i, None if i == 2 else f"t{i}", float("nan") if i else 1.0, 2**62) for i in range(5)],
                               "g int, id long, s string, v double, w long")
    assert {r["s"] for r in K.resamples(df, ["g"], "s", ["id"], 40, 1).collect()} == {"t0", "t1", None, "t3", "t4"}
    means = [r["total"] / r["n"] for r in K.resample_totals(df, ["g"], "v", ["id"], 10, 1).collect()]
    assert any(math.isnan(m) for m in means) and K.bootstrap_ci(df, ["g"], "v", ["id"], n=10).first()["n"] == 5
    with pytest.raises(Exception, match="[Oo]verflow|too (big|large)"):
        K.resample_totals(df, ["g"], "w", ["id"], 10, 1).collect()
