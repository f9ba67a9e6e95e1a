"""Embedding near-dedup by an epsilon grid order join.

Vectors are scaled to length one, so a cosine of at least c is a distance of at most
eps = sqrt(2 - 2 c). They are sorted by their grid cells (side eps) along the leading
principal directions; the sequence is cut into blocks, blocks into a tree of intervals.
Starting from (root, root), pairs of intervals are split recursively: a pair that is
provably farther apart than eps is skipped, a pair that lies provably within eps links as a
whole, and what is left at the bottom is compared block against block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import components, stage
from platewise.operators.ordered import global_rank

FAN = 8  # children of an interval
SUB = 128  # rows of the smallest interval, inside a task
SAFE = 1e-9  # margin of the distance proofs over rounding
NODE = "o long, n long, lowest long, lo binary, hi binary, mid binary, radius double"


def _unit(raw: bytes, dim: int, dtype: str) -> np.ndarray:
    x = np.frombuffer(raw, dtype).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def _gaps(lo_a, hi_a, lo_b, hi_b) -> np.ndarray:
    """Least distance between boxes along the last axis."""
    return np.sqrt((np.maximum(0.0, np.maximum(lo_a - hi_b, lo_b - hi_a)) ** 2).sum(-1))


def _far_and_near(lo_a, hi_a, mid_a, rad_a, lo_b, hi_b, mid_b, rad_b, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of intervals are provably apart, and which provably within eps."""
    between = np.linalg.norm(mid_a - mid_b, axis=-1)
    far = (between - rad_a - rad_b > eps + SAFE) | (_gaps(lo_a, hi_a, lo_b, hi_b) > eps + SAFE)
    return far, between + rad_a + rad_b <= eps - SAFE


def _summary(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    mid = p.mean(0)
    return p.min(0), p.max(0), mid, float(np.linalg.norm(p - mid, axis=1).max())


def _intervals(p: np.ndarray) -> tuple[np.ndarray, ...]:
    parts = [_summary(p[i:i + SUB]) for i in range(0, len(p), SUB)]
    return tuple(np.array(x) for x in zip(*parts))


def join_blocks(a: np.ndarray, b: np.ndarray, same: bool, cosine: float, axes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links between two blocks of unit vectors: (links of a's rows, of b's rows, label of each row of a then b).

    Rows with equal labels are connected by the block pair's own links.
    """
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    parent = list(range(len(a) + len(b)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    if same:
        for i in range(len(a)):
            union(i, len(a) + i)
    ia, ib = _intervals(a @ axes), _intervals(b @ axes)
    far, _ = _far_and_near(*(x[:, None] for x in ia), *(x[None] for x in ib), eps)
    for i, j in zip(*np.nonzero(~far)):
        if same and j < i:
            continue
        ra, rb = slice(i * SUB, (i + 1) * SUB), slice(j * SUB, (j + 1) * SUB)
        hit = a[ra] @ b[rb].T >= cosine
        if same and i == j:
            np.fill_diagonal(hit, False)
        if not hit.any():
            continue
        na[ra] += hit.sum(1)
        if not (same and i == j):
            (na if same else nb)[rb] += hit.sum(0)
        for r in np.flatnonzero(hit.any(1)):
            cols = np.flatnonzero(hit[r])
            for c in cols.tolist():
                union(i * SUB + int(r), len(a) + j * SUB + c)
    return na, nb, np.array([find(x) for x in range(len(parent))])


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95,
                 block_rows: int = 2048, cell_dims: int = 8, sample_rows: int = 8192) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when their cosine in double precision is at least ``cosine``. A row whose
    vector is null, empty, zero, holds null or non-finite components, or has another length
    than most (ties: the longer) links with nothing and stands alone. component_id is the
    smallest id reachable by links, kept is id = component_id; a null id never names a
    component that has an id, and of a component without ids the first row is kept. Repeated
    rows are separate vectors that link with each other. Other columns are ignored; an
    empty table gives an empty one.

    Only the choice of principal directions uses a sample (about ``sample_rows`` rows picked
    by hash, four times as many at most); it steers the sort, never the result. Every step is a join or a bounded group:
    interval pairs are rows of a DataFrame, split level by level, and a group holds two
    blocks. A crowd of copies or near copies closer than eps links interval to interval,
    without its pairs being formed.
    """
    dtype = "<f4" if vectors.schema[vec_col].dataType == T.ArrayType(T.FloatType()) else "<f8"
    eps = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    v = F.col("vec")
    good = F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~F.exists(
        v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    src = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).withColumn("good", good)
    common = (src.filter("good").groupBy(F.size("vec").alias("dim")).count()
              .agg(F.max(F.struct("count", "dim")).alias("m")).first()["m"])
    alone = src.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return alone
    dim, total = common["dim"], common["count"]
    usable = F.col("good") & (F.size("vec") == dim)
    alone = src.filter(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
                                       F.lit(True).alias("kept"))
    src = src.filter(usable).select("id", "vec")

    share = min(1.0, sample_rows / total)
    # picked by row, so a hot vector gives its share of the sample only; the limit bounds what comes back
    picked = (src.filter(F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 20)) < int(math.ceil(share * (1 << 20)))).select("vec")
              .limit(4 * sample_rows))
    sample = np.array([r[0] for r in picked.collect()], np.float64).reshape(-1, dim)
    sample /= np.linalg.norm(sample, axis=1)[:, None]
    axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim))[1][:, ::-1] if len(sample) > 1 else np.eye(dim)
    lead = min(cell_dims, dim)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.asarray(e, dtype) for e in pdf["vec"]])
                u = x.astype(np.float64)
                u /= np.linalg.norm(u, axis=1)[:, None]
                out = {"id": pdf["id"], "raw": [e.tobytes() for e in x]}
                at = np.floor(u @ axes[:, :lead] / max(eps, 1e-6)).astype(np.int32)
                yield pd.DataFrame(out | {f"c{k}": at[:, k] for k in range(lead)})

    cs = [f"c{k}" for k in range(lead)]
    celled = src.withColumn("id", F.col("id").cast("string")).mapInPandas(
        cells, "id string, raw binary, " + ", ".join(f"{c} int" for c in cs))
    celled = celled.withColumn("id", F.col("id").cast(vectors.schema[id_col].dataType))
    ranked = stage(global_rank(celled, [*cs, "id", "raw"], out_col="rank").select(
        "id", "raw", "rank", F.floor(F.col("rank") / block_rows).alias("o")))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        raw = b"".join(pdf["raw"])
        lo, hi, mid, rad = _summary(_unit(raw, dim, dtype) @ axes)
        return pd.DataFrame([{"o": pdf["o"].iloc[0], "n": len(pdf), "lowest": pdf["rank"].iloc[0], "lo": lo.tobytes(),
                              "hi": hi.tobytes(), "mid": mid.tobytes(), "radius": rad, "raw": raw}])

    blocks = stage(ranked.groupBy("o").applyInPandas(block, NODE + ", raw binary"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        get = lambda c: np.stack([np.frombuffer(x) for x in pdf[c]])
        n, mids = pdf["n"].to_numpy(), get("mid")
        mid = (mids * n[:, None]).sum(0) / n.sum()
        rad = float((np.linalg.norm(mids - mid, axis=1) + pdf["radius"]).max())
        return pd.DataFrame([{"o": pdf["o"].iloc[0] // FAN, "n": n.sum(), "lowest": pdf["lowest"].min(),
                              "lo": get("lo").min(0).tobytes(), "hi": get("hi").max(0).tobytes(), "mid": mid.tobytes(),
                              "radius": rad}])

    levels = [blocks.drop("raw")]
    while levels[-1].filter("o > 0").limit(1).count():
        levels.append(stage(levels[-1].groupBy(F.floor(F.col("o") / FAN)).applyInPandas(merge, NODE)))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            get = lambda c: np.stack([np.frombuffer(x) for x in pdf[c]])
            far, near = _far_and_near(get("lo_a"), get("hi_a"), get("mid_a"), pdf["radius_a"].to_numpy(), get("lo_b"),
                                      get("hi_b"), get("mid_b"), pdf["radius_b"].to_numpy(), eps)
            out = pdf[["a", "b", "n_a", "n_b", "lowest_a", "lowest_b"]].assign(near=near)
            yield out[~far]

    fields = ["o", "n", "lowest", "lo", "hi", "mid", "radius"]
    side = lambda t, s: t.select(*[F.col(c).alias(f"{c}_{s}") for c in fields])
    pair_type = "a long, b long, n_a long, n_b long, lowest_a long, lowest_b long, near boolean"

    def judged(pairs: DataFrame) -> DataFrame:
        return stage(pairs.withColumn("a", F.col("o_a")).withColumn("b", F.col("o_b")).mapInPandas(judge, pair_type))

    whole: list[DataFrame] = []
    top = len(levels) - 1
    cur = judged(side(levels[top], "a").join(side(levels[top], "b"), F.col("o_a") == F.col("o_b")))
    for level in range(top, -1, -1):
        whole.append(cur.filter("near").withColumn("level", F.lit(level)))
        cur = cur.filter("not near").select("a", "b")
        if level:
            kids = levels[level - 1]
            cur = judged(cur.join(side(kids, "a").withColumn("a", F.floor(F.col("o_a") / FAN)), "a")
                         .join(side(kids, "b").withColumn("b", F.floor(F.col("o_b") / FAN)), "b")
                         .filter("a <> b or o_a <= o_b"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        a, b = pdf.iloc[0], pdf.iloc[-1]
        ua, ub = _unit(a["raw"], dim, dtype), _unit(b["raw"], dim, dtype)
        same = len(pdf) == 1
        na, nb, label = join_blocks(ua, ub, same, cosine, axes)
        rank = np.append(np.arange(len(ua)) + a["lowest"], np.arange(len(ub)) + b["lowest"])
        out = pd.DataFrame({"rank": rank, "links": np.append(na, nb), "root": rank[label]})
        return out[(out["links"] > 0) | (out["rank"] != out["root"])]

    two = cur.select("a", "b", F.col("a").alias("o")).unionAll(cur.filter("a <> b").select("a", "b", F.col("b").alias("o")))
    leaf = stage(two.join(blocks.select("o", "lowest", "raw"), "o").select("a", "b", "o", "lowest", "raw")
                 .groupBy("a", "b").applyInPandas(compare, "rank long, links long, root long"))

    # pairs of intervals that link as a whole: counts and ends per interval, handed down to its blocks
    w = whole[0]
    for more in whole[1:]:
        w = w.unionAll(more)
    w = stage(w)
    other = F.when(F.col("a") == F.col("b"), F.col("n_a") - 1)
    gains = (w.select("level", F.col("a").alias("node"), F.coalesce(other, F.col("n_b")).alias("gain"), F.col("lowest_a").alias("low"))
             .unionAll(w.filter("a <> b").select("level", F.col("b").alias("node"), F.col("n_a").alias("gain"), F.col("lowest_b").alias("low")))
             .groupBy("level", "node").agg(F.sum("gain").alias("gain"), F.min("low").alias("low")))
    up = F.explode(F.transform(F.sequence(F.lit(0), F.lit(top)), lambda i: F.struct(
        i.alias("level"), F.floor(F.col("o") / F.pow(F.lit(float(FAN)), i)).alias("node"))))
    per_block = stage(levels[0].select("o", "lowest", up.alias("x")).select("o", "lowest", "x.level", "x.node")
                      .join(gains, ["level", "node"]).select("o", "lowest", "gain", "low"))
    block_gain = stage(per_block.groupBy("o").agg(F.sum("gain").alias("gain"), F.first("lowest").alias("lowest")))
    members = ranked.select("rank", "o").join(block_gain, "o")

    links = (leaf.select("rank", "links").unionAll(members.select("rank", F.col("gain").alias("links")))
             .groupBy("rank").agg(F.sum("links").alias("n_links")))
    edges = (leaf.select(F.col("rank").alias("a"), F.col("root").alias("b"))
             .unionAll(members.select(F.col("rank").alias("a"), F.col("lowest").alias("b")))
             .unionAll(per_block.select(F.col("lowest").alias("a"), F.col("low").alias("b")))
             .unionAll(w.select(F.col("lowest_a").alias("a"), F.col("lowest_b").alias("b"))))
    comp = components(edges)
    found = stage(ranked.select("id", "rank").join(links, "rank", "left")
                  .join(comp, F.col("rank") == F.col("node"), "left")
                  .select("id", "rank", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "rank").alias("root")))
    names = stage(found.groupBy("root").agg(F.min("id").alias("component_id"), F.min("rank").alias("first")))
    kept = (F.when(F.col("component_id").isNull(), F.col("rank") == F.col("first"))
            .otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))))
    return found.join(names, "root").select("id", "n_links", "component_id", kept.alias("kept")).unionAll(alone)
