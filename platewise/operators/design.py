"""Initial designs: random, farthest point, k-means, k-medoids, cluster members.

Each round is one narrow pass over the candidates against a parameter-sized set
(k chosen points or k centres) held as a literal array; per-round results of
size k come back to the driver, and lineage is cut with reliable checkpoints.
The N x N distance matrix of the reference is never built.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.kernels import euclidean, jaccard_distance, sqdist
from platewise.functions.rand import md5_u32
from platewise.operators.ordered import global_rank
from platewise.operators.similarity import TILE_BLOCKS, TILE_BYTES, TILE_ROWS, literal_set
from platewise.operators.tiles import matrix, self_tiles
from platewise.session import cut_lineage

METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean,
    "sqeuclidean": sqdist,
    "jaccard": jaccard_distance,
}


def _metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric '{name}'; choose one of {sorted(METRICS)}")
    return METRICS[name]


# ------------------------------------------------------------------ E6
def init_random(df: DataFrame, id_col: str, k: int, seed: int = 0) -> list:
    """K random candidates: smallest md5(seed:id) draws (TakeOrdered of k rows)."""
    key = md5_u32(F.lit(str(seed)), F.col(id_col))
    return [r[0] for r in df.select(id_col, key.alias("__r")).orderBy("__r", id_col).limit(k).collect()]


# ------------------------------------------------------------------ E7
def init_maxmin(df: DataFrame, id_col: str, features: str, k: int, metric: str = "jaccard", seed: int = 0,
                first_id=None, checkpoint_every: int = 5) -> list[tuple]:
    """Farthest-point design. First pick = given id or lowest md5(seed:id); each next
    pick = largest distance to the chosen set (ties -> lowest id). Chosen rows keep
    min distance 0. O(k * N): a running ``min_dist`` column, one pass per pick.

    Returns [(order, id, min_dist_at_pick)].
    """
    dist = _metric(metric)
    state = df.select(id_col, features)
    if first_id is None:
        first_id = init_random(state, id_col, 1, seed)[0]
    picks = [(0, first_id, None)]
    vec = state.filter(F.col(id_col) == F.lit(first_id)).first()[features]
    state = state.withColumn("min_dist", dist(F.col(features), F.lit(vec).cast("array<double>")))
    for i in range(1, k):
        if i % checkpoint_every == 0:
            state = cut_lineage(state)
        top = state.orderBy(F.col("min_dist").desc(), F.col(id_col)).select(id_col, features, "min_dist").first()
        picks.append((i, top[id_col], float(top["min_dist"])))
        new = F.lit(top[features]).cast("array<double>")
        state = state.withColumn("min_dist", F.least(F.col("min_dist"), dist(F.col(features), new)))
    return picks


# ------------------------------------------------------------------ E8
def _assign(features: str, centres: list[list[float]], dist: Callable = sqdist) -> Column:
    """Index of the nearest centre (ties -> lowest index) and its distance, as a struct."""
    cs = F.array(*[F.lit(c).cast("array<double>") for c in centres])
    ds = F.transform(cs, lambda c, i: F.struct(dist(F.col(features), c).alias("d"), i.alias("c")))
    return F.array_min(ds)


def lloyd(df: DataFrame, features: str, centres: list[list[float]], rounds: int, tol: float = 0.0
          ) -> tuple[list[list[float]], DataFrame]:
    """Lloyd iterations: nearest centre by squared distance (ties to the lower index), then the
    mean of each cluster; an empty cluster keeps its centre. Stops early when no centre moves
    more than ``tol``.

    The vectors are written once as bytes; a round is one narrow pass over them, whose tasks
    each send one vector sum per cluster. Sums are added in task order, so a round that changes
    no assignment gives the same centres to the last bit."""
    cur = np.array(centres, float)
    packed = cut_lineage(df.filter(F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("v")).mapInPandas(
        lambda batches: (pd.DataFrame({"x": [np.asarray(v, float).tobytes() for v in b["v"]]}) for b in batches), "x binary"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("task")
        total = np.stack([np.frombuffer(s) for s in pdf["s"]]).sum(0)
        return pd.DataFrame([{"cluster": pdf["cluster"].iloc[0], "n": pdf["n"].sum(), "s": total.tobytes()}])

    for _ in range(rounds):
        def partial(batches, at=cur):
            n, s = np.zeros(len(at), np.int64), np.zeros(at.shape)
            for pdf in batches:
                if len(pdf):
                    x = np.frombuffer(b"".join(pdf["x"])).reshape(len(pdf), -1)
                    own = np.stack([((x - c) ** 2).sum(1) for c in at]).argmin(0)
                    n += np.bincount(own, minlength=len(at))
                    np.add.at(s, own, x)
            yield pd.DataFrame([(TaskContext.get().partitionId(), c, n[c], s[c].tobytes()) for c in np.flatnonzero(n)],
                               columns=["task", "cluster", "n", "s"])

        sums = packed.mapInPandas(partial, "task int, cluster int, n long, s binary")
        new = cur.copy()
        for r in sums.groupBy("cluster").applyInPandas(merge, "cluster int, n long, s binary").collect():  # a row per centre
            new[r["cluster"]] = np.frombuffer(r["s"]) / r["n"]
        shift = np.sqrt(((new - cur) ** 2).sum(1)).max()
        cur = new
        if shift <= tol:
            break
    found = cur.tolist()
    return found, df.withColumn("cluster", _assign(features, found)["c"])


def nearest_distinct(df: DataFrame, id_col: str, features: str, centres: list[list[float]]) -> list:
    """Each centre takes its nearest row; a row already taken by an earlier centre is
    skipped. Centre i can lose at most i rows, so its i+1 nearest suffice: one job of
    k bounded top-(i+1) selections."""
    parts = []
    for i, c in enumerate(centres):
        d = euclidean(F.col(features), F.lit(c).cast("array<double>"))
        parts.append(df.select(F.lit(i).alias("centre"), id_col, d.alias("d"))
                     .orderBy("d", id_col).limit(i + 1))
    near = reduce(lambda a, b: a.unionByName(b), parts).collect()
    by_c: dict[int, list] = {}
    for r in sorted(near, key=lambda r: (r["centre"], r["d"], r[id_col])):
        by_c.setdefault(r["centre"], []).append(r[id_col])
    taken: list = []
    for i in range(len(centres)):
        pick = next(x for x in by_c[i] if x not in taken)
        taken.append(pick)
    return taken


def init_kmeans(df: DataFrame, id_col: str, features: str, k: int, use_pca: int | None = None,
                rounds: int = 300, seed: int = 0, tol: float = 1e-9, engine: str = "lloyd") -> tuple[list, DataFrame]:
    """Optional PCA, k-means, then the nearest distinct row to every centre.

    ``engine='lloyd'`` starts from the k lowest md5(seed:id) rows (reproducible, and
    the oracle's start); ``engine='mllib'`` runs MLlib KMeans (k-means||) instead.
    Returns (representative ids in centre order, rows with their cluster).
    """
    d = df
    feats = features
    if use_pca:
        from platewise.operators.scale import pca_project

        d, _ = pca_project(df, use_pca, features, scale=False, out_col="__pcs")
        feats = "__pcs"
    d = cut_lineage(d.select(id_col, feats))
    if engine == "mllib":
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        model = KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="__v").fit(
            d.withColumn("__v", array_to_vector(feats)))
        centres = [list(map(float, c)) for c in model.clusterCenters()]
    else:
        start_ids = init_random(d, id_col, k, seed)
        rows = {r[id_col]: r[feats] for r in d.filter(F.col(id_col).isin(start_ids)).collect()}
        centres = [list(map(float, rows[i])) for i in start_ids]
        centres, _ = lloyd(d, feats, centres, rounds, tol)
    assigned = d.withColumn("cluster", _assign(feats, centres)["c"])
    reps = nearest_distinct(d, id_col, feats, centres)
    return reps, assigned.withColumnRenamed(feats, features) if feats != features else assigned


# ------------------------------------------------------------------ E9
NEAR = 1e-6  # share of the squared norms below which a squared distance is taken from the differences
FINALIST = 1e-7  # relative distance from the smallest sum up to which sums are compared exactly


def _np_distances(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of the rows of a to those of b, to a relative 1e-8 (jaccard: exact)."""
    if metric == "jaccard":
        same = np.stack([((x == b) & (x != 0)).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))
        met = (a != 0).astype(float) @ (b != 0).astype(float).T
        some = (a != 0).sum(1)[:, None] + (b != 0).sum(1) - met
        return np.where(some > 0, (some - same) / np.maximum(some, 1), 0.0)
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)
    sq = norms - 2.0 * (a @ b.T)
    i, j = np.nonzero(sq <= NEAR * norms)
    for s in range(0, len(i), 1 << 16):
        at = i[s:s + (1 << 16)], j[s:s + (1 << 16)]
        sq[at] = ((a[at[0]] - b[at[1]]) ** 2).sum(1)
    return sq if metric == "sqeuclidean" else np.sqrt(sq)


def _best_members(a: DataFrame, id_col: str, features: str, metric: str, pivots: dict[int, list[float]],
                  batch: int) -> dict[int, object]:
    """The member of each cluster with the smallest summed distance to all members (ties: lowest id).

    Members are dealt to blocks that meet two at a time, so a task holds two blocks and a strip of
    their distances, and a member is sent once per block of its cluster. Those sums are right
    to a relative 1e-8; members within ``FINALIST`` of the smallest are summed again from the
    differences, ``batch`` vectors of each cluster in one pass, equal vectors once.
    """
    dist = _metric(metric)
    centres = {c: np.array(p, float) for c, p in pivots.items() if None not in p}  # no vector counts as near an unknown one
    if metric == "jaccard":
        centres = dict.fromkeys(centres, 0.0)
    a = a.filter(F.col("cluster").isin(list(centres)))
    whole = F.coalesce(~F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double"))), F.lit(False))
    a = a.filter(whole).select("__at", id_col, F.col(features).cast("array<double>").alias(features), "cluster")
    size = {r["cluster"]: (r["n"], r["d"]) for r in a.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(features)).alias("d")).collect()}
    if not size:
        return {}
    n, dims = max(v[0] for v in size.values()), max(v[1] for v in size.values())
    rows = max(TILE_ROWS, min(-(-n // TILE_BLOCKS), TILE_BYTES // (8 * max(dims, 1))))
    count = F.element_at(F.array(*[F.lit(-(-size.get(c, (1,))[0] // rows)) for c in range(max(size) + 1)]), F.col("cluster") + 1)
    dealt = a.select(F.col("cluster").alias("g"), (count * F.lit(rows)).cast("bigint").alias("total"),
                     F.pmod(F.xxhash64("__at"), count).cast("int").alias("o"), "__at", F.col(features).alias("data"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["data"].to_numpy()).astype(float)
        x = x - np.nan_to_num(centres[int(pdf["g"].iloc[0])])
        return pd.DataFrame([{"g": pdf["g"].iloc[0], "total": pdf["total"].iloc[0], "o": pdf["o"].iloc[0], "n": len(x),
                              "at": pdf["__at"].to_numpy(np.int64).tobytes(), "data": x.tobytes()}])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) == 1 and pdf["__i"].iloc[0] != pdf["__j"].iloc[0]:  # the other block got no member
            return pd.DataFrame({"g": [], "at": [], "s": []})
        x, y = (matrix(pdf[c].iloc[k], pdf["n"].iloc[k]) for c, k in (("data", 0), ("data", -1)))
        by_row, by_col = np.zeros(len(x)), np.zeros(len(y))
        for s in range(0, len(x), TILE_ROWS // 2):
            d = _np_distances(metric, x[s:s + TILE_ROWS // 2], y)
            by_row[s:s + len(d)] = d.sum(1)
            by_col += d.sum(0)
        parts = [(-1, by_col)] if len(pdf) == 1 else [(0, by_row), (-1, by_col)]
        return pd.concat([pd.DataFrame({"g": pdf["g"].iloc[k], "at": np.frombuffer(pdf["at"].iloc[k], np.int64), "s": v})
                          for k, v in parts])

    blocks = cut_lineage(dealt.groupBy("g", "o").applyInPandas(pack, "g int, total long, o int, n int, at binary, data binary"))
    sums = cut_lineage(self_tiles(blocks, rows, tile, "g int, at long, s double").groupBy("g", "at").agg(F.sum("s").alias("s")))
    least = {r["g"]: r["s"] for r in sums.groupBy("g").agg(F.min("s").alias("s")).collect()}
    limit = F.element_at(F.array(*[F.lit(least.get(c, 0.0) * (1 + FINALIST)) for c in range(max(least) + 1)]), F.col("g") + 1)
    close = sums.filter(F.col("s") <= limit).select(F.col("at").alias("__at"))
    finalists = cut_lineage(a.join(close, "__at").groupBy("cluster", features).agg(F.min(id_col).alias("id")))
    left = {r["cluster"]: r["n"] for r in finalists.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    best: dict[int, tuple] = {r["cluster"]: (0.0, r["id"]) for r in finalists.filter(
        F.col("cluster").isin([c for c, k in left.items() if k == 1])).collect()}
    seen: dict[int, object] = {c: None for c, k in left.items() if k > 1}
    while seen:
        parts = [finalists.filter((F.col("cluster") == c) & (F.lit(True) if i is None else F.col("id") > F.lit(i)))
                 .orderBy("id").limit(batch) for c, i in seen.items()]
        got: dict[int, list] = {}
        for r in reduce(lambda x, y: x.unionByName(y), parts).collect():
            got.setdefault(r["cluster"], []).append((r["id"], r[features]))
        seen = {c: max(i for i, _ in v) for c, v in got.items() if len(v) == batch}
        if not got:
            break
        kind = a.schema[id_col].dataType.simpleString()
        per_c = F.array(*[literal_set(got[c], kind) if c in got else
                          F.array().cast(f"array<struct<id:{kind},v:array<double>>>") for c in range(max(got) + 1)])
        tried = a.filter(F.col("cluster").isin(list(got)))
        again = (tried.select("cluster", F.explode(F.transform(F.element_at(per_c, F.col("cluster") + 1), lambda q: F.struct(
            q["id"].alias("cand"), dist(F.col(features), q["v"]).alias("d")))).alias("s"))
                 .groupBy("cluster", "s.cand").agg(F.sum("s.d").alias("tot"))
                 .groupBy("cluster").agg(F.min(F.struct("tot", "cand")).alias("b")).collect())
        for r in again:
            new = (r["b"]["tot"], r["b"]["cand"])
            best[r["cluster"]] = min(best.get(r["cluster"], new), new)
    return {c: v[1] for c, v in best.items()}


def init_kmedoids(df: DataFrame, id_col: str, features: str, k: int, metric: str = "euclidean",
                  max_iter: int = 300, seed: int = 0, batch: int = 256) -> tuple[list, DataFrame]:
    """Alternating k-medoids, exact: assign every row to its nearest medoid (literal set),
    then replace each medoid by the member of its cluster with the smallest summed distance,
    until none changes.

    Every member is a candidate, and sums run over all members, block against block; the
    distances of a round are the squares of the clusters' sizes. Rows with null or NaN features
    are in no sum.
    """
    dist = _metric(metric)
    d = cut_lineage(df.select(id_col, features).withColumn("__at", F.monotonically_increasing_id()))
    med_ids = init_random(d, id_col, k, seed)
    for _ in range(max_iter):
        meds = {r[id_col]: list(r[features]) for r in d.filter(F.col(id_col).isin(med_ids)).collect()}
        pivots = {c: meds[i] for c, i in enumerate(med_ids)}
        a = d.withColumn("cluster", _assign(features, [meds[i] for i in med_ids], dist)["c"])
        new = list(med_ids)
        for c, i in _best_members(a, id_col, features, metric, pivots, batch).items():
            new[c] = i
        if new == med_ids:
            break
        med_ids = new
    meds = {r[id_col]: r[features] for r in d.filter(F.col(id_col).isin(med_ids)).collect()}
    assigned = d.drop("__at").withColumn("cluster", _assign(features, [meds[i] for i in med_ids], dist)["c"])
    return med_ids, assigned


# ------------------------------------------------------------------ E10
def cluster_members(assigned: DataFrame, id_col: str, features: str, reps: Sequence) -> DataFrame:
    """Members of each cluster ordered by euclidean distance to its representative.

    The order inside a cluster is a slice of one distributed global rank over
    (cluster, distance, id): a cluster holding a third of all rows is still spread
    over many range partitions.
    """
    vecs = {r[id_col]: r[features] for r in assigned.filter(F.col(id_col).isin(list(reps))).collect()}
    rv = F.array(*[F.lit(vecs[i]).cast("array<double>") for i in reps])
    d = assigned.withColumn("dist", euclidean(F.col(features), F.element_at(rv, F.col("cluster") + 1)))
    ranked = global_rank(d.select(id_col, "cluster", "dist"), ["cluster", "dist", id_col])
    first = ranked.groupBy("cluster").agg(F.min("rank").alias("__r0"))
    return ranked.join(F.broadcast(first), "cluster").select(
        "cluster", (F.col("rank") - F.col("__r0")).alias("member_rank"), id_col, "dist")


# ------------------------------------------------------------------ E11 / E12
def initialize(df: DataFrame, method: str, id_col: str = "candidate_id", features: str = "features",
               k: int = 10, metric: str = "euclidean", use_pca: int | None = None, seed: int = 0,
               exclude: DataFrame | None = None) -> list:
    """Pick the initial design by name; ``exclude`` ids are removed first."""
    d = df.join(exclude.select(id_col), id_col, "left_anti") if exclude is not None else df
    if method in ("random", "true_random"):
        return init_random(d, id_col, k, seed)
    if method == "maxmin":
        return [i for _, i, _ in init_maxmin(d, id_col, features, k, metric, seed)]
    if method == "kmeans":
        return init_kmeans(d, id_col, features, k, use_pca=use_pca, seed=seed)[0]
    if method == "kmedoids":
        return init_kmedoids(d, id_col, features, k, metric, seed=seed)[0]
    raise ValueError(f"Unknown init_method: {method}; choose random, maxmin, kmeans or kmedoids")


def prepare(df: DataFrame, target: str = "y", id_col: str = "candidate_id", features: str = "features",
            representation: str | None = None, design: str = "random", k: int = 10, seed: int = 0,
            design_options: dict | None = None, **featurize_options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From a table of candidates to (train, heldout, stats).

    Optional featurisation by name, rows without features and duplicate vectors dropped, an
    initial design by name, and the target's statistics over all kept rows. The prepared table
    is checkpointed once; train and heldout are filters on it.
    """
    from platewise.operators.clean import preprocess
    from platewise.operators.features import featurize
    from platewise.operators.metrics import target_stats

    d = featurize(df, representation, id_col=id_col, **featurize_options) if representation else df
    kept = cut_lineage(preprocess(d, id_col, features))
    ids = initialize(kept, design, id_col, features, k, seed=seed, **(design_options or {}))
    split = split_initial(kept, ids, id_col)
    return (split.filter("status = 'train'"), split.filter("status = 'heldout'"), target_stats(kept, target, features))


def split_initial(df: DataFrame, ids: Sequence, id_col: str = "candidate_id") -> DataFrame:
    """Chosen rows -> train, the rest -> heldout (a status column, no data moves)."""
    return df.withColumn("status", F.when(F.col(id_col).isin(list(ids)), "train").otherwise("heldout"))
