"""Catalogue entries for similarity, initial design, surrogate and loop.

The oracles for the surrogate and the loop are SQL-unrolled *sequential
conditioning*: one CTE per train point appends one entry to every candidate's
whitened vector (a different route from the Cholesky solve used on the Spark
side for G1/G2), compared at 4 decimals.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from platewise.functions.kernels import SQRT5, euclidean, jaccard_distance, sql_kernel, sql_sqdist
from platewise.functions.normal import sql_ei_core
from platewise.functions.rand import sql_md5_u32
from platewise.operators import design as E
from platewise.operators import features as C
from platewise.operators import joint as JOINT
from platewise.operators import loop as LOOP
from platewise.operators import similarity as S
from platewise.operators import surrogate as G
from platewise.operators.acquire import MIN_VAR
from platewise.plans.registry import register, rounded
from platewise.sources import fixtures as FX
from platewise.sources.tables import table

VEC = FX.with_sql(FX.SQL_VEC)
VEC_LOOP = VEC.replace("WITH", "WITH RECURSIVE", 1)


def _d(v: float) -> str:
    return f"{v!r}::DOUBLE"


def md5_order(seed: int, col: str = "candidate_id") -> str:
    return sql_md5_u32(f"'{seed}:' || {col}::VARCHAR")


def first_by_md5(spark, d, k: int, seed: int = 0) -> list[tuple]:
    v = FX.vec(spark, d)
    ids = E.init_random(v, "candidate_id", k, seed)
    rows = {r["candidate_id"]: r["features"] for r in v.filter(F.col("candidate_id").isin(ids)).collect()}
    return [(i, rows[i]) for i in ids]


REFS_SQL = f"refs AS (SELECT candidate_id AS ref_id, features AS rv FROM vec ORDER BY {md5_order(0)}, candidate_id LIMIT 5)"


# ---------------------------------------------------------------- E1
def _fp_lists(src: str, text: str, name: str, n_bits: int = 2048) -> str:
    from platewise.plans.features_q import sql_grams

    bit = f"({sql_md5_u32('gram')} % {n_bits})::INTEGER"
    return f""", {sql_grams(name + "_g", src, text, 1, 3, distinct=True)},
{name} AS (SELECT candidate_id, list(DISTINCT {bit} ORDER BY {bit}) AS bits
           FROM {name}_g GROUP BY candidate_id)"""


@register("tanimoto_pairs", rounded(FX.with_sql(FX.SQL_TEXT, "bench AS (SELECT item_id AS candidate_id, text FROM benchmark)")
                                    + _fp_lists("txt", "text", "dfp") + _fp_lists("bench", "text", "bfp") + f"""
SELECT a.candidate_id, b.candidate_id AS query_id,
       greatest((len(list_intersect(a.bits, b.bits))::DOUBLE + 1e-6::DOUBLE)
                / (1e-6::DOUBLE + len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits))::DOUBLE), 0.0::DOUBLE) AS similarity
FROM dfp a, bfp b""", ["similarity"]))
def q_tanimoto_pairs(spark, d):
    docs = C.hashed_fingerprint(FX.text(spark, d), "text", 3, 2048)
    bench = C.hashed_fingerprint(table(spark, d, "benchmark").select(F.col("item_id").alias("candidate_id"), "text"),
                                 "text", 3, 2048)
    return S.tanimoto_to_queries(docs, bench, "candidate_id", "bits")


# ---------------------------------------------------------------- E2
# The similarity join runs on near-collision-free prints (2^20 positions), so that prints of
# long texts are not alike only because most of 2048 positions are set.
E2_BITS = 1 << 20


@register("similar_above", rounded(FX.with_sql(FX.SQL_TEXT) + _fp_lists("txt", "text", "dfp", E2_BITS) + """,
reps AS (SELECT min(candidate_id) AS id, bits, len(bits) AS n FROM dfp GROUP BY bits),
pairs AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.bits, b.bits))::DOUBLE AS inter, a.n AS na, b.n AS nb
          FROM reps a JOIN reps b ON a.id < b.id
          WHERE least(a.n, b.n) >= 0.8::DOUBLE * greatest(a.n, b.n)),
sims AS (SELECT id_a, id_b, (inter + 1e-6::DOUBLE) / (1e-6::DOUBLE + na + nb - inter) AS similarity FROM pairs)
SELECT id_a, id_b, similarity FROM sims WHERE similarity >= 0.8::DOUBLE
UNION ALL
SELECT r.id, f.candidate_id, 1.0::DOUBLE FROM dfp f JOIN reps r ON f.bits = r.bits WHERE f.candidate_id <> r.id""", ["similarity"]))
def q_similar_above(spark, d):
    docs = C.hashed_fingerprint(FX.text(spark, d), "text", 3, E2_BITS)
    pairs, copies = S.similar_above(docs, "candidate_id", "bits", 0.8)
    return pairs.unionByName(copies.filter("id <> representative_id").select(
        F.col("representative_id").alias("id_a"), F.col("id").alias("id_b"), F.lit(1.0).alias("similarity")))


# ---------------------------------------------------------------- E3
@register("pairwise_distance", rounded(VEC + ", " + REFS_SQL + f"""
SELECT v.candidate_id, r.ref_id, sqrt({sql_sqdist('v.features', 'r.rv')}) AS euclidean,
       CASE WHEN nz = 0 THEN 0.0 ELSE df::DOUBLE / nz::DOUBLE END AS jaccard
FROM (SELECT v.*, r.*, list_sum(list_transform(list_zip(v.features, r.rv), lambda p: CASE WHEN p[1] <> 0 OR p[2] <> 0 THEN 1 ELSE 0 END)) AS nz,
             list_sum(list_transform(list_zip(v.features, r.rv), lambda p: CASE WHEN (p[1] <> 0 OR p[2] <> 0) AND p[1] <> p[2] THEN 1 ELSE 0 END)) AS df
      FROM vec v, refs r) v JOIN refs r USING (ref_id)""".replace("sqrt(list_sum(list_transform(list_zip(v.features, r.rv)",
                                                                   "sqrt(list_sum(list_transform(list_zip(v.features, v.rv)"),
                                       ["euclidean", "jaccard"]))
def q_pairwise_distance(spark, d):
    refs = first_by_md5(spark, d, 5)
    rs = S.literal_set(refs)
    out = F.transform(rs, lambda r: F.struct(r["id"].alias("ref_id"),
                                             euclidean(F.col("features"), r["v"]).alias("euclidean"),
                                             jaccard_distance(F.col("features"), r["v"]).alias("jaccard")))
    return FX.vec(spark, d).select("candidate_id", F.explode(out).alias("s")).select(
        "candidate_id", "s.ref_id", "s.euclidean", "s.jaccard")


# ---------------------------------------------------------------- E4
KERNELS = ["linear", "tanimoto", "matern05", "matern15", "matern25", "rq", "matern25+linear"]


def _e4_sql() -> str:
    parts = [f"SELECT v.candidate_id, r.ref_id, '{k}' AS kernel, {sql_kernel(k, 'v.features', 'r.rv')} AS k "
             f"FROM vec v, refs r" for k in KERNELS]
    return VEC + ", " + REFS_SQL + "\n" + "\nUNION ALL\n".join(parts)


@register("kernel_values", rounded(_e4_sql(), ["k"]))
def q_kernel_values(spark, d):
    refs = first_by_md5(spark, d, 5)
    v = FX.vec(spark, d)
    outs = [S.kernel_against(v, "candidate_id", "features", refs, k).withColumn("kernel", F.lit(k)) for k in KERNELS]
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), outs).select("candidate_id", "ref_id", "kernel", "k")


# ---------------------------------------------------------------- E5
@register("average_similarity", rounded(VEC + f""", k AS (
  SELECT a.candidate_id AS i, b.candidate_id AS j, {sql_kernel('matern25', 'a.features', 'b.features')} AS k
  FROM vec a, vec b WHERE a.candidate_id <> b.candidate_id),
c AS (SELECT j, min(k) AS lo, max(k) AS hi FROM k GROUP BY j)
SELECT avg(CASE WHEN hi = lo THEN 0.0 ELSE (k - lo) / (hi - lo) END) AS average_similarity FROM k JOIN c USING (j)""",
                                        ["average_similarity"]))
def q_average_similarity(spark, d):
    return S.average_similarity(FX.vec(spark, d), "candidate_id", "features", "matern25")


# ---------------------------------------------------------------- E6
@register("init_random", VEC + f"""
SELECT candidate_id, row_number() OVER (ORDER BY {md5_order(0)}, candidate_id) - 1 AS pick
FROM vec ORDER BY {md5_order(0)}, candidate_id LIMIT 10""")
def q_init_random(spark, d):
    ids = E.init_random(FX.vec(spark, d), "candidate_id", 10, 0)
    return FX.vec(spark, d).select("candidate_id").filter(F.col("candidate_id").isin(ids)).withColumn(
        "pick", F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("candidate_id")) - 1)


# ---------------------------------------------------------------- E7
def _maxmin_sql(k: int, seed: int = 0) -> str:
    parts = [f""", m0 AS (SELECT candidate_id, features, sqrt({sql_sqdist('features', '(SELECT features FROM vec ORDER BY ' + md5_order(seed) + ', candidate_id LIMIT 1)')}) AS md
     FROM vec),
p0 AS (SELECT 0 AS pick, candidate_id, NULL::DOUBLE AS min_dist FROM vec ORDER BY {md5_order(seed)}, candidate_id LIMIT 1)"""]
    for i in range(1, k):
        parts.append(f""",
p{i} AS MATERIALIZED (SELECT {i} AS pick, candidate_id, md AS min_dist, features FROM m{i - 1} ORDER BY md DESC, candidate_id LIMIT 1),
m{i} AS MATERIALIZED (SELECT m.candidate_id, m.features, least(m.md, sqrt({sql_sqdist('m.features', 'p.features')})) AS md
         FROM m{i - 1} m, p{i} p)""")
    sel = " UNION ALL ".join(f"SELECT pick, candidate_id, min_dist FROM p{i}" for i in range(k))
    return VEC + "".join(parts) + "\n" + sel


@register("init_maxmin", rounded(_maxmin_sql(10), ["min_dist"]))
def q_init_maxmin(spark, d):
    picks = E.init_maxmin(FX.vec(spark, d), "candidate_id", "features", 10, metric="euclidean", seed=0)
    return spark.createDataFrame([(i, int(c), m) for i, c, m in picks], "pick int, candidate_id bigint, min_dist double")


# ---------------------------------------------------------------- E8 / E10
def _kmeans_sql(k: int, rounds: int, seed: int = 0) -> tuple[str, str]:
    """CTEs ending with ``cent{rounds}`` (centre lists) and ``asg`` (candidate -> cluster)."""
    def assign(cent: str) -> str:
        return (f"(SELECT v.candidate_id, v.features, list_position(ds, list_min(ds)) - 1 AS cluster FROM "
                f"(SELECT v.*, list_transform(c.cs, lambda c: {sql_sqdist('v.features', 'c')}) AS ds "
                f"FROM vec v, {cent} c) v)")

    parts = [f""", start AS (SELECT candidate_id, features FROM vec ORDER BY {md5_order(seed)}, candidate_id LIMIT {k}),
cent0 AS (SELECT list(features ORDER BY {md5_order(seed)}, candidate_id) AS cs FROM start)"""]
    for r in range(1, rounds + 1):
        parts.append(f""",
a{r} AS MATERIALIZED {assign(f'cent{r - 1}')},
mm{r} AS (SELECT cluster, dim, avg(v) AS m FROM (SELECT cluster, generate_subscripts(features, 1) AS dim,
          unnest(features) AS v FROM a{r}) GROUP BY cluster, dim),
nc{r} AS (SELECT cluster, list(m ORDER BY dim) AS c FROM mm{r} GROUP BY cluster),
cent{r} AS MATERIALIZED (SELECT list(coalesce(n.c, o.c) ORDER BY o.i) AS cs FROM
            (SELECT unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i FROM cent{r - 1}) o
            LEFT JOIN nc{r} n ON n.cluster = o.i)""")
    parts.append(f""",
asg AS {assign(f'cent{rounds}')}""")
    # nearest distinct row per centre, greedy in centre order
    for i in range(k):
        taken = " UNION ALL ".join(f"SELECT candidate_id FROM r{j}" for j in range(i)) or "SELECT NULL::BIGINT AS candidate_id"
        parts.append(f""",
r{i} AS MATERIALIZED (SELECT {i} AS centre, v.candidate_id FROM vec v, cent{rounds} c
         WHERE v.candidate_id NOT IN (SELECT candidate_id FROM ({taken}) WHERE candidate_id IS NOT NULL)
         ORDER BY sqrt({sql_sqdist('v.features', f'c.cs[{i + 1}]')}), v.candidate_id LIMIT 1)""")
    reps = " UNION ALL ".join(f"SELECT centre, candidate_id FROM r{i}" for i in range(k))
    return "".join(parts), reps


KM_K, KM_ROUNDS = 5, 40  # the SQL side unrolls more rounds than the supplied tables need to come to rest
_km_ctes, _km_reps = _kmeans_sql(KM_K, KM_ROUNDS)


def kmeans_run(spark, d):
    return E.init_kmeans(FX.vec(spark, d), "candidate_id", "features", KM_K, seed=0, tol=0.0)


@register("init_kmeans", VEC + _km_ctes + "\n" + _km_reps)
def q_init_kmeans(spark, d):
    reps, _ = kmeans_run(spark, d)
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(reps)], "centre int, candidate_id bigint")


@register("cluster_members", rounded(VEC + _km_ctes + f""",
reps AS ({_km_reps}),
dd AS (SELECT a.cluster, a.candidate_id, sqrt({sql_sqdist('a.features', 'rv.features')}) AS dist
       FROM asg a JOIN reps r ON r.centre = a.cluster JOIN vec rv ON rv.candidate_id = r.candidate_id)
SELECT cluster, row_number() OVER (PARTITION BY cluster ORDER BY dist, candidate_id) - 1 AS member_rank,
       candidate_id, dist FROM dd""", ["dist"]))
def q_cluster_members(spark, d):
    reps, assigned = kmeans_run(spark, d)
    return E.cluster_members(assigned, "candidate_id", "features", reps).withColumn(
        "cluster", F.col("cluster").cast("int"))


# ---------------------------------------------------------------- E9
def _kmedoids_sql(k: int, rounds: int, seed: int = 0) -> str:
    """Rounds of exact k-medoids over all member pairs; more rounds than needed change nothing."""
    parts = [f""", dd AS MATERIALIZED (SELECT x.candidate_id AS a, y.candidate_id AS b, sqrt({sql_sqdist('x.features', 'y.features')}) AS d
  FROM vec x, vec y),
med0 AS (SELECT row_number() OVER (ORDER BY {md5_order(seed)}, candidate_id) - 1 AS cluster, candidate_id AS m
  FROM vec ORDER BY {md5_order(seed)}, candidate_id LIMIT {k})"""]
    for r in range(1, rounds + 1):
        parts.append(f""",
as{r} AS MATERIALIZED (SELECT a AS id, arg_min(cluster, (d, cluster)) AS cluster FROM dd JOIN med{r - 1} ON b = m GROUP BY a),
med{r} AS MATERIALIZED (SELECT cluster, arg_min(a, (s, a)) AS m FROM (
  SELECT x.cluster, dd.a, sum(d) AS s FROM dd JOIN as{r} x ON x.id = dd.a JOIN as{r} y ON y.id = dd.b AND y.cluster = x.cluster
  GROUP BY x.cluster, dd.a) GROUP BY cluster)""")
    return "".join(parts) + f"\nSELECT cluster::INTEGER AS cluster, m AS candidate_id FROM med{rounds}"


@register("init_kmedoids", VEC + _kmedoids_sql(5, 16))
def q_init_kmedoids(spark, d):
    meds, _ = E.init_kmedoids(FX.vec(spark, d), "candidate_id", "features", 5, metric="euclidean")
    return spark.createDataFrame([(i, int(c)) for i, c in enumerate(meds)], "cluster int, candidate_id bigint")


# ---------------------------------------------------------------- E11 / E12 / E13
@register("initialize", VEC + f"""
SELECT candidate_id FROM vec WHERE label <> 9 ORDER BY {md5_order(0)}, candidate_id LIMIT 10""")
def q_initialize(spark, d):
    v = FX.vec(spark, d)
    ids = E.initialize(v, "random", k=10, seed=0, exclude=v.filter(F.col("label") == 9))
    return v.filter(F.col("candidate_id").isin(ids)).select("candidate_id")


@register("split_initial", VEC + f""", ids AS (SELECT candidate_id FROM vec ORDER BY {md5_order(0)}, candidate_id LIMIT 10)
SELECT candidate_id, CASE WHEN candidate_id IN (SELECT candidate_id FROM ids) THEN 'train' ELSE 'heldout' END AS status
FROM vec""")
def q_split_initial(spark, d):
    v = FX.vec(spark, d)
    return E.split_initial(v, E.init_random(v, "candidate_id", 10, 0)).select("candidate_id", "status")


@register("prepare", rounded(VEC + f""", ok AS (SELECT * FROM vec WHERE NOT list_bool_or(list_transform(features, lambda x: x IS NULL OR isnan(x)))),
kept AS (SELECT * FROM ok WHERE candidate_id IN (SELECT min(candidate_id) FROM ok GROUP BY features)),
ids AS (SELECT candidate_id FROM kept ORDER BY {md5_order(0)}, candidate_id LIMIT 10)
SELECT candidate_id, y, CASE WHEN candidate_id IN (SELECT candidate_id FROM ids) THEN 'train' ELSE 'heldout' END AS status,
       (SELECT max(y) FROM kept) AS target_stat_max, (SELECT count(y) FROM kept) AS input_stat_n_points
FROM kept""", ["y", "target_stat_max"]))
def q_prepare(spark, d):
    train, heldout, stats = E.prepare(FX.vec(spark, d))
    s = stats.first()
    return train.unionByName(heldout).select(
        "candidate_id", "y", "status", F.lit(s["target_stat_max"]).alias("target_stat_max"),
        F.lit(s["input_stat_n_points"]).cast("bigint").alias("input_stat_n_points"))


# ---------------------------------------------------------------- G1: sequential-conditioning SQL
CFG = G.GPConfig()


def _seq_sql(pick_exprs: list[str], cfg: G.GPConfig = CFG, prefix: str = "") -> tuple[str, str]:
    """CTE chain adding train points in order; returns (ctes, last state name).

    State ``{p}s{j}``: candidate_id, features, y, w, A, B, Q, obs; globals ``{p}g{j}``: u, v1, ys.
    """
    p = prefix
    dot = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda q: q[1] * q[2])), 0.0::DOUBLE)"
    parts = [f""", {p}s0 AS (SELECT candidate_id, features, y, []::DOUBLE[] AS w, 0.0::DOUBLE AS A, 0.0::DOUBLE AS B,
                0.0::DOUBLE AS Q, false AS obs FROM vec),
{p}g0 AS (SELECT []::DOUBLE[] AS u, []::DOUBLE[] AS v1, []::DOUBLE[] AS ys)"""]
    for j, pid in enumerate(pick_exprs, start=1):
        parts.append(f""",
{p}c{j} AS MATERIALIZED (SELECT s.candidate_id AS pid, s.features AS pv, s.y AS py, s.w AS pw,
              sqrt({_d(cfg.outputscale)} + {_d(cfg.noise)} - s.Q) AS ltt
       FROM {p}s{j - 1} s WHERE s.candidate_id = ({pid})),
{p}g{j} AS MATERIALIZED (SELECT list_append(g.u, (c.py - {dot.format(a='c.pw', b='g.u')}) / c.ltt) AS u,
              list_append(g.v1, (1.0::DOUBLE - {dot.format(a='c.pw', b='g.v1')}) / c.ltt) AS v1,
              list_append(g.ys, c.py) AS ys,
              (c.py - {dot.format(a='c.pw', b='g.u')}) / c.ltt AS ut,
              (1.0::DOUBLE - {dot.format(a='c.pw', b='g.v1')}) / c.ltt AS vt
       FROM {p}g{j - 1} g, {p}c{j} c),
{p}s{j} AS MATERIALIZED (SELECT candidate_id, features, y, list_append(w, wt) AS w, A + wt * ut AS A, B + wt * vt AS B,
              Q + wt * wt AS Q, obs OR candidate_id = pid AS obs
       FROM (SELECT s.*, ({sql_kernel(cfg.kernel, 's.features', 'c.pv', cfg.lengthscale, cfg.outputscale, cfg.alpha)}
                          - {dot.format(a='s.w', b='c.pw')}) / c.ltt AS wt, g.ut, g.vt, c.pid
             FROM {p}s{j - 1} s, {p}c{j} c, {p}g{j} g))""")
    return "".join(parts), f"{p}s{len(pick_exprs)}"


def _posterior_cols(state: str, g: str) -> str:
    m = f"list_avg({g}.ys)"
    sd = f"list_stddev_samp({g}.ys)"
    return (f"{m} + {state}.A - {m} * {state}.B AS mu, "
            f"greatest({sd} * {sd} * ({_d(CFG.outputscale)} - {state}.Q), 0.0::DOUBLE) AS var")


N_TRAIN = 10


def _init_picks(n: int, seed: int = 0) -> list[str]:
    return [f"SELECT candidate_id FROM vec ORDER BY {md5_order(seed)}, candidate_id LIMIT 1 OFFSET {j}" for j in range(n)]


_g1_ctes, _g1_last = _seq_sql(_init_picks(N_TRAIN))


@register("gp_posterior", rounded(VEC + _g1_ctes + f"""
SELECT {_g1_last}.candidate_id, {_posterior_cols(_g1_last, f'g{N_TRAIN}')} FROM {_g1_last}, g{N_TRAIN}""",
                                  ["mu", "var"], digits=4), digits=4)
def q_gp_posterior(spark, d):
    v = FX.vec(spark, d)
    ids = E.init_random(v, "candidate_id", N_TRAIN, 0)
    _, x, y = G.collect_train(v.filter(F.col("candidate_id").isin(ids)), "candidate_id", "features", "y")
    model = G.fit_gp(x, y, CFG)
    return G.gp_posterior(v, model, "candidate_id", "features")


# ---------------------------------------------------------------- H2 (joint)
def _joint_sql() -> str:
    """Covariance of every label's test rows from their whitened vectors, then Gaussian elimination,
    one recursion step per row; column 0 holds the residuals."""
    w, g, m = _g1_last, f"g{N_TRAIN}", f"list_avg(g{N_TRAIN}.ys)"
    sd = f"list_stddev_samp({g}.ys)"
    return VEC_LOOP + _g1_ctes + f""",
test AS MATERIALIZED (
  SELECT v.label, s.candidate_id, s.features, s.w, {sd} AS sd, s.y - ({m} + s.A - {m} * s.B) AS r,
         row_number() OVER (PARTITION BY v.label ORDER BY s.candidate_id) AS i
  FROM {w} s JOIN vec v USING (candidate_id), {g} WHERE NOT s.obs),
cov AS MATERIALIZED (
  SELECT a.label, a.i, b.i AS j, a.sd * a.sd * ({sql_kernel(CFG.kernel, 'a.features', 'b.features', CFG.lengthscale, CFG.outputscale, CFG.alpha)}
         - list_inner_product(a.w, b.w) + CASE WHEN a.i = b.i THEN {_d(CFG.noise)} ELSE 0.0 END) AS v
  FROM test a JOIN test b ON a.label = b.label
  UNION ALL SELECT label, i, 0, r FROM test),
elim AS (
  SELECT 1::BIGINT AS k, label, i, j, v FROM cov
  UNION ALL
  SELECT k + 1, label, i, j, v - pc * pr / pp FROM (
    SELECT *, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY label, i) AS pc,
           max(CASE WHEN i = k THEN v END) OVER (PARTITION BY label, j) AS pr,
           max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY label) AS pp FROM elim)
  WHERE i > k AND (j > k OR j = 0)),
piv AS (SELECT label, k, max(CASE WHEN j = k THEN v END) AS p, max(CASE WHEN j = 0 THEN v END) AS r FROM elim WHERE i = k GROUP BY label, k)
SELECT label, count(*) AS n, sum(ln(p)) AS log_det, (sum(r * r / p) + sum(ln(p))) / (2 * count(*)) + {_d(0.5 * math.log(2 * math.pi))} AS nlpd_joint
FROM piv GROUP BY label"""


@register("nlpd_joint", rounded(_joint_sql(), ["log_det", "nlpd_joint"], digits=4), digits=4)
def q_nlpd_joint(spark, d):
    v = FX.vec(spark, d)
    ids = E.init_random(v, "candidate_id", N_TRAIN, 0)
    _, x, y = G.collect_train(v.filter(F.col("candidate_id").isin(ids)), "candidate_id", "features", "y")
    return JOINT.nlpd_joint(v.filter(~F.col("candidate_id").isin(ids)), G.fit_gp(x, y, CFG), "candidate_id", "features", "y", ["label"])


# ---------------------------------------------------------------- G2 / G3
GRID = dict(lengthscales=[0.25, 0.5, 1.0, 2.0], outputscales=[0.5, 1.0, 2.0], noises=[1e-4, 1e-2])


def _g2_sql() -> str:
    rows = [(i, l, o, n) for i, (l, o, n) in enumerate(
        (l, o, n) for l in GRID["lengthscales"] for o in GRID["outputscales"] for n in GRID["noises"])]
    vals = ", ".join(f"({i}, {_d(l)}, {_d(o)}, {_d(n)})" for i, l, o, n in rows)
    dot = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda q: q[1] * q[2])), 0.0::DOUBLE)"
    r = "(sqrt({sq}) / s.lengthscale)".format(sq=sql_sqdist("s.features", "c.pv"))
    kern = f"(s.outputscale * ((1.0::DOUBLE + {_d(SQRT5)} * {r} + {_d(5.0 / 3.0)} * {r} * {r}) * exp({_d(-SQRT5)} * {r})))"
    parts = [f""", grid AS (SELECT * FROM (VALUES {vals}) t(grid_id, lengthscale, outputscale, noise)),
tr AS (SELECT candidate_id, features, y FROM vec ORDER BY {md5_order(0)}, candidate_id LIMIT {N_TRAIN}),
tro AS (SELECT *, row_number() OVER (ORDER BY {md5_order(0)}, candidate_id) AS k FROM tr),
st AS (SELECT avg(y) AS m, stddev_samp(y) AS sd FROM tr),
gs0 AS (SELECT g.*, t.candidate_id, t.k, t.features, (t.y - st.m) / st.sd AS ys, []::DOUBLE[] AS w
        FROM grid g, tro t, st),
gg0 AS (SELECT grid_id, []::DOUBLE[] AS r, 0.0::DOUBLE AS lsum FROM grid)"""]
    for j in range(1, N_TRAIN + 1):
        parts.append(f""",
gc{j} AS MATERIALIZED (SELECT grid_id, features AS pv, ys AS py, w AS pw,
               sqrt(outputscale + noise - {dot.format(a='w', b='w')}) AS ltt FROM gs{j - 1} WHERE k = {j}),
gg{j} AS MATERIALIZED (SELECT g.grid_id, list_append(g.r, (c.py - {dot.format(a='c.pw', b='g.r')}) / c.ltt) AS r,
               g.lsum + ln(c.ltt) AS lsum FROM gg{j - 1} g JOIN gc{j} c USING (grid_id)),
gs{j} AS MATERIALIZED (SELECT s.grid_id, s.lengthscale, s.outputscale, s.noise, s.candidate_id, s.k, s.features, s.ys,
               list_append(s.w, ({kern} - {dot.format(a='s.w', b='c.pw')}) / c.ltt) AS w
        FROM gs{j - 1} s JOIN gc{j} c USING (grid_id))""")
    return VEC + "".join(parts) + f""",
scored AS (SELECT g.grid_id, g.lengthscale, g.outputscale, g.noise,
                  -0.5::DOUBLE * {dot.format(a='x.r', b='x.r')} - x.lsum - {_d(0.5 * N_TRAIN * math.log(2 * math.pi))} AS log_ml
           FROM grid g JOIN gg{N_TRAIN} x USING (grid_id))"""


G2_SQL = _g2_sql()


def scored_grid(spark, d):
    v = FX.vec(spark, d)
    ids = E.init_random(v, "candidate_id", N_TRAIN, 0)
    _, x, y = G.collect_train(v.filter(F.col("candidate_id").isin(ids)), "candidate_id", "features", "y")
    grid = G.grid_frame(spark, GRID["lengthscales"], GRID["outputscales"], GRID["noises"])
    return G.gp_select_hyper(grid, x, y, CFG)


@register("gp_select_hyper", rounded(G2_SQL + "\nSELECT * FROM scored", ["lengthscale", "outputscale", "noise", "log_ml"],
                                     digits=4), digits=4)
def q_gp_select_hyper(spark, d):
    return scored_grid(spark, d)


@register("hyper_report", rounded(G2_SQL + """,
best AS (SELECT * FROM scored ORDER BY log_ml DESC, grid_id LIMIT 1)
SELECT grid_id, name, value FROM (UNPIVOT best ON lengthscale, outputscale, noise INTO NAME name VALUE value)""",
                                  ["value"], digits=4), digits=4)
def q_hyper_report(spark, d):
    return G.hyper_report(G.best_hyper(scored_grid(spark, d)))


# ---------------------------------------------------------------- G6
NEI_DRAWS = 100


def _chol_sql(name: str, src: str, n: int) -> str:
    """One row of columns a_i_j (i >= j) becomes one row of its Cholesky factor's l_i_j, column by column."""
    out, prev = [], src
    for j in range(n):
        less = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        out.append(f"{name}d{j} AS (SELECT *, sqrt(a_{j}_{j}{less}) AS l_{j}_{j} FROM {prev})")
        cols = [f"(a_{i}_{j}{''.join(f' - l_{i}_{k} * l_{j}_{k}' for k in range(j))}) / l_{j}_{j} AS l_{i}_{j}" for i in range(j + 1, n)]
        out.append(f"{name}{j} AS MATERIALIZED (SELECT {', '.join(['*', *cols])} FROM {name}d{j})")
        prev = f"{name}{j}"
    return ",\n" + ",\n".join(out)


def _nei_sql(n: int = N_TRAIN, draws: int = NEI_DRAWS, cfg: G.GPConfig = CFG) -> str:
    """Draws of the posterior at the train rows, and for each a noise-free model by sequential
    conditioning on the train rows in order, as in ``_seq_sql``; the Halton table is stated."""
    z = G.halton_normals(draws, n)
    table = ", ".join(f"({s}, [{', '.join(repr(float(v)) for v in row)}]::DOUBLE[])" for s, row in enumerate(z))
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    kern = sql_kernel(cfg.kernel, "p.features", "q.features", cfg.lengthscale, cfg.outputscale, cfg.alpha)
    pick = ", ".join(f"max(CASE WHEN i = {i} AND j = {j} THEN k END) AS k_{i}_{j}" for i, j in pairs)
    ctes = f""", tr AS (SELECT candidate_id, features, y FROM vec ORDER BY {md5_order(0)}, candidate_id LIMIT {n}),
tro AS (SELECT *, row_number() OVER (ORDER BY candidate_id) - 1 AS i FROM tr),
st AS (SELECT avg(y) AS m, stddev_samp(y) AS sd FROM tr),
kk AS (SELECT p.i, q.i AS j, {kern} AS k FROM tro p, tro q WHERE q.i <= p.i),
km AS MATERIALIZED (SELECT {pick} FROM kk),
ys AS MATERIALIZED (SELECT {', '.join(f"max(CASE WHEN i = {i} THEN (y - m) / sd END) AS y_{i}" for i in range(n))} FROM tro, st),
noisy AS (SELECT *, {', '.join(f"k_{i}_{j}{f' + {_d(cfg.noise)}' if i == j else ''} AS a_{i}_{j}" for i, j in pairs)} FROM km, ys)"""
    ctes += _chol_sql("cn", "noisy", n)
    sym = lambda i, j: f"k_{max(i, j)}_{min(i, j)}"
    prev = f"cn{n - 1}"
    for i in range(n):  # u = L^-1 y and v_c = L^-1 k_c, row by row
        minus = lambda a: "".join(f" - l_{i}_{k} * {a}{k}" for k in range(i))
        cols = [f"(y_{i}{minus('u_')}) / l_{i}_{i} AS u_{i}"]
        cols += [f"({sym(i, c)}{minus(f'v_{c}_')}) / l_{i}_{i} AS v_{c}_{i}" for c in range(n)]
        ctes += f",\nfs{i} AS MATERIALIZED (SELECT *, {', '.join(cols)} FROM {prev})"
        prev = f"fs{i}"
    post = [f"{' + '.join(f'v_{c}_{k} * u_{k}' for k in range(n))} AS mu_{c}" for c in range(n)]
    cov = [f"k_{i}_{j} - ({' + '.join(f'v_{i}_{k} * v_{j}_{k}' for k in range(n))}){f' + {_d(G.NEI_JITTER)}' if i == j else ''} AS a_{i}_{j}"
           for i, j in pairs]
    ctes += f",\npost AS MATERIALIZED (SELECT {', '.join(post + cov)} FROM {prev})" + _chol_sql("cc", "post", n)
    fs = ", ".join(f"mu_{i} + {' + '.join(f'l_{i}_{k} * z[{k + 1}]' for k in range(i + 1))}" for i in range(n))
    ctes += f""",
z AS (SELECT * FROM (VALUES {table}) t(draw, z)),
f AS MATERIALIZED (SELECT draw, [{fs}] AS f FROM cc{n - 1}, z),
free AS (SELECT {', '.join(f"k_{i}_{j}{f' + {_d(G.NEI_NOISE)}' if i == j else ''} AS a_{i}_{j}" for i, j in pairs)} FROM km)"""
    ctes += _chol_sql("cf", "free", n)
    prev = "f"
    rows = ", ".join(f"l_{i}_{j}" for i, j in pairs)
    ctes += f",\nw0 AS (SELECT draw, list_max(f) AS best, f, {rows} FROM f, cf{n - 1})"
    for i in range(n):  # per draw: w = L^-1 f
        ctes += (f",\nw{i + 1} AS MATERIALIZED (SELECT *, (f[{i + 1}]{''.join(f' - l_{i}_{k} * w_{k}' for k in range(i))}) / l_{i}_{i} AS w_{i} "
                 f"FROM w{i})")
    held = f"(SELECT candidate_id, features FROM vec WHERE candidate_id NOT IN (SELECT candidate_id FROM tr))"
    kx = sql_kernel(cfg.kernel, "h.features", "t.features", cfg.lengthscale, cfg.outputscale, cfg.alpha)
    ctes += f""",
hk AS (SELECT h.candidate_id, {', '.join(f"max(CASE WHEN t.i = {i} THEN {kx} END) AS x_{i}" for i in range(n))}
       FROM {held} h, tro t GROUP BY h.candidate_id),
h0 AS (SELECT * FROM hk, (SELECT {rows} FROM cf{n - 1}))"""
    for i in range(n):  # per candidate: g = L^-1 k(x)
        ctes += (f",\nh{i + 1} AS MATERIALIZED (SELECT *, (x_{i}{''.join(f' - l_{i}_{k} * g_{k}' for k in range(i))}) / l_{i}_{i} AS g_{i} "
                 f"FROM h{i})")
    dot = " + ".join(f"h.g_{k} * w.w_{k}" for k in range(n))
    own = " + ".join(f"h.g_{k} * h.g_{k}" for k in range(n))
    zz = "((mu - best) / s)"
    return VEC + ctes + f""",
e AS (SELECT h.candidate_id, st.m + st.sd * ({dot}) AS mu, st.m + st.sd * w.best AS best,
             sqrt(greatest(st.sd * st.sd * greatest({_d(cfg.outputscale)} - ({own}), 0.0::DOUBLE), {_d(MIN_VAR)})) AS s
      FROM h{n} h, w{n} w, st)
SELECT candidate_id, avg(s * {sql_ei_core(zz)}) AS acq FROM e GROUP BY candidate_id"""


@register("acq_nei", rounded(_nei_sql(), ["acq"], digits=4), digits=4)
def q_acq_nei(spark, d):
    v = FX.vec(spark, d)
    ids = E.init_random(v, "candidate_id", N_TRAIN, 0)
    _, x, y = G.collect_train(v.filter(F.col("candidate_id").isin(ids)), "candidate_id", "features", "y")
    return G.noisy_ei(v.filter(~F.col("candidate_id").isin(ids)), G.fit_gp(x, y, CFG), "candidate_id", "features", NEI_DRAWS)


# ---------------------------------------------------------------- G11 / G13: unrolled loop
N_ITERS = 100  # as long as a campaign of the survey


def _loop_sql(runs: dict[str, dict], n_init: int, n_iters: int, beta: float = 0.1, cfg: G.GPConfig = CFG) -> str:
    """The loop by sequential conditioning, one recursion step per observed row: a row per (run,
    candidate) with its whitened vector w and running sums, the run's own vectors beside it."""
    dot = "coalesce(list_sum(list_transform(list_zip({a}, {b}), lambda q: q[1] * q[2])), 0.0::DOUBLE)"
    vals = ", ".join(f"('{r}', {c['seed']}, '{c['acquisition']}')" for r, c in runs.items())
    kern = sql_kernel(cfg.kernel, "features", "p.features", cfg.lengthscale, cfg.outputscale, cfg.alpha)
    sd = f"sqrt(greatest(var, {_d(MIN_VAR)}))"
    ei = f"({sd} * {sql_ei_core(f'((mu - best) / {sd})')})"
    order = "PARTITION BY run_id ORDER BY obs, key, candidate_id"
    return f""", runs AS (SELECT * FROM (VALUES {vals}) t(run_id, seed, acquisition)),
loop AS (
  SELECT 0 AS step, run_id, acquisition, candidate_id, features, y,
         row_number() OVER (PARTITION BY run_id ORDER BY {sql_md5_u32("seed::VARCHAR || ':' || candidate_id::VARCHAR")}, candidate_id) AS r,
         []::DOUBLE[] AS w, 0.0::DOUBLE AS A, 0.0::DOUBLE AS B, 0.0::DOUBLE AS Q, false AS obs, []::DOUBLE[] AS u,
         []::DOUBLE[] AS v1, []::DOUBLE[] AS ys, NULL::BIGINT AS pick_id, NULL::DOUBLE AS pick_y, NULL::DOUBLE AS best_so_far,
         NULL::DOUBLE AS acq_sum
  FROM runs, vec
  UNION ALL
  SELECT step + 1, run_id, acquisition, candidate_id, features, y, r, list_append(w, wt), A + wt * ut, B + wt * vt, Q + wt * wt,
         obs OR candidate_id = p.id, list_append(u, ut), list_append(v1, vt), list_append(ys, p.y), p.id, p.y, best, acq_total
  FROM (SELECT *, ({kern} - {dot.format(a='w', b='p.w')}) / ltt AS wt FROM (
  SELECT *, (p.y - {dot.format(a='p.w', b='u')}) / ltt AS ut, (1.0::DOUBLE - {dot.format(a='p.w', b='v1')}) / ltt AS vt FROM (
  SELECT *, sqrt({_d(cfg.outputscale)} + {_d(cfg.noise)} - p.q) AS ltt FROM (
  SELECT *, first_value({{'id': candidate_id, 'features': features, 'y': y, 'w': w, 'q': Q}}) OVER ({order}) AS p,
         sum(acq) OVER (PARTITION BY run_id) AS acq_total FROM (
  SELECT *, CASE WHEN step < {n_init} THEN CASE WHEN r = step + 1 THEN 0 ELSE 1 END ELSE -acq END AS key FROM (
  SELECT *, CASE WHEN NOT obs AND step >= {n_init} THEN CASE acquisition WHEN 'ucb' THEN mu + sqrt({_d(beta)} * var) ELSE {ei} END END AS acq FROM (
  SELECT *, m + A - m * B AS mu, greatest(s * s * ({_d(cfg.outputscale)} - Q), 0.0::DOUBLE) AS var FROM (
  SELECT *, list_avg(ys) AS m, list_stddev_samp(ys) AS s, list_max(ys) AS best FROM loop WHERE step < {n_init + n_iters})))))))))
SELECT run_id, step - {n_init + 1} AS iteration, best_so_far, pick_id AS suggestion_id, pick_y AS suggestion_y, acq_sum
FROM loop WHERE step > {n_init} AND candidate_id = pick_id"""


def _trace_frame(spark, trace):
    return spark.createDataFrame(
        [(t.run_id, t.iteration, t.best_so_far, int(t.suggestion_id), t.suggestion_y, t.acq_sum) for t in trace],
        "run_id string, iteration int, best_so_far double, suggestion_id bigint, suggestion_y double, acq_sum double")


@register("bo_trace", rounded(VEC_LOOP + _loop_sql({"run": {"seed": 0, "acquisition": "ucb"}}, N_TRAIN, N_ITERS),
                              ["best_so_far", "suggestion_y", "acq_sum"], digits=4), digits=4)
def q_bo_trace(spark, d):
    tr = LOOP.optimise(FX.vec(spark, d), "candidate_id", "features", "y", N_TRAIN, N_ITERS, "ucb", seed=0, cfg=CFG)
    return _trace_frame(spark, tr)


GRID_POINTS = [(l, o, n) for l in GRID["lengthscales"] for o in GRID["outputscales"] for n in GRID["noises"]]


@register("bo_trace_refit", digits=4)
def q_bo_trace_refit(spark, d):
    """The campaign with hyperparameters refitted before every step and batches of four, each
    pick given those before it (no SQL: the tests hold it to a full refit per step)."""
    tr = LOOP.optimise(FX.vec(spark, d), "candidate_id", "features", "y", N_TRAIN, N_ITERS, "ucb", seed=0, cfg=CFG,
                       b=4, batch="greedy", grid=GRID_POINTS)
    return spark.createDataFrame(
        [(t.iteration, t.best_so_far, int(i), k, t.lengthscale, t.outputscale, t.noise) for t in tr for k, i in enumerate(t.picked)],
        "iteration int, best_so_far double, suggestion_id bigint, pick int, lengthscale double, outputscale double, noise double")


#: The survey's sweep: 20 seeds, two settings of each.
SWEEP = {f"{a}_s{s}": {"seed": s, "acquisition": a} for s in range(20) for a in ("ucb", "ei")}


@register("run_sweep", rounded(VEC_LOOP + _loop_sql(SWEEP, N_TRAIN, N_ITERS), ["best_so_far", "suggestion_y", "acq_sum"], digits=4),
          digits=4)
def q_run_sweep(spark, d):
    tr = LOOP.run_sweep(FX.vec(spark, d), "candidate_id", "features", "y", SWEEP, N_TRAIN, N_ITERS, CFG)
    return _trace_frame(spark, tr)
