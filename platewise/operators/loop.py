"""The optimisation loop for one campaign or many at once.

A run's train set is small (initial design and picks), its candidates are not. So the model
goes to the candidates: every step ships one fitted model per run in the task closure, scores
all candidates in one narrow pass over a table that holds each candidate's features once, and
brings back the best rows of each run. Nothing about a run is kept beside a candidate, so a
step neither rewrites nor shuffles candidates, memory doesn't grow with runs or steps, and a
lost task repeats only its own share of one pass.

Before a step, the hyperparameters of every run can be refitted: the marginal likelihood of
each (run, grid point) is one row of a DataFrame, so a sweep's refits spread over tasks too.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from platewise.functions.normal import np_ei
from platewise.functions.rand import md5_u32
from platewise.operators.surrogate import GPConfig, GPModel, Nei, fit_gp, log_marginal_likelihood, nei_model, predict_np
from platewise.session import cut_lineage, spread

ACQUISITIONS = {"ucb", "ei", "nei", "random"}
BATCHES = {"top", "greedy"}


class Step(NamedTuple):
    """One iteration of one run."""
    run_id: str
    iteration: int
    best_so_far: float
    suggestion_id: object
    suggestion_y: float
    acq_sum: float | None
    picked: list
    lengthscale: float
    outputscale: float
    noise: float


@dataclass
class Run:
    """What a run knows: its observed rows, in order, and its present hyperparameters."""
    acquisition: str
    seed: int
    cfg: GPConfig
    ids: list = field(default_factory=list)
    xs: list = field(default_factory=list)
    ys: list = field(default_factory=list)

    def add(self, rows: Sequence[Row]) -> None:
        for r in rows:
            self.ids.append(r["id"])
            self.xs.append(np.frombuffer(r["x"]))
            self.ys.append(float(r["y"]))


@dataclass
class Scorer:
    """One run as the tasks see it."""
    run_id: str
    acquisition: str
    model: GPModel
    seen: np.ndarray
    best: float
    beta: float
    nei: Nei | None = None

    def __call__(self, x: np.ndarray, ks: np.ndarray | None = None) -> np.ndarray:
        if self.nei is not None:
            return self.nei(x)
        mu, var = predict_np(self.model, x, ks=ks)
        if self.acquisition == "ucb":
            return mu + np.sqrt(self.beta * var)
        return np_ei(mu, var, self.best)


def pack_candidates(cands: DataFrame, id_col: str, features: str, y: str) -> DataFrame:
    """(id, x binary, y): every candidate once, written where a lost executor finds it again, over all
    cores: every step reads them, so few splits of the input would hold up each one.

    Rows with a null id, target or features, or a null or NaN feature, can't be scored or
    observed and are left out."""
    whole = F.coalesce(~F.exists(features, lambda v: v.isNull() | F.isnan(v.cast("double"))), F.lit(False))
    d = cands.filter(whole & F.col(id_col).isNotNull() & F.col(y).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(features).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(x=[np.asarray(v, float).tobytes() for v in pdf["x"]])

    return cut_lineage(spread(d).mapInPandas(pack, f"id {d.schema['id'].dataType.simpleString()}, x binary, y double"))


def _lowest_draws(rows: DataFrame, k: int) -> DataFrame:
    """The k rows of each run with the lowest ``draw``, ties to the lowest id (limited before the shuffle)."""
    w = Window.partitionBy("run_id").orderBy("draw", "id")
    return rows.withColumn("pick", F.row_number().over(w)).filter(F.col("pick") <= k)


def initial_designs(cands: DataFrame, runs: Mapping[str, Run], n_init: int) -> None:
    """Every run observes its n_init lowest md5(seed:id) draws: one pass for all seeds."""
    seeds = sorted({r.seed for r in runs.values()})
    drawn = cands.withColumn("run_id", F.explode(F.array(*[F.lit(s) for s in seeds])))
    drawn = drawn.withColumn("draw", md5_u32(F.col("run_id"), F.col("id")))
    rows = _lowest_draws(drawn, n_init).orderBy("run_id", "pick").collect()  # seeds x n_init rows
    for r in runs.values():
        r.add([x for x in rows if x["run_id"] == r.seed])


def given_designs(cands: DataFrame, runs: Mapping[str, Run], designs: Mapping[str, Sequence]) -> None:
    """Every run observes the ids given for it, in that order."""
    wanted = sorted({i for ids in designs.values() for i in ids})
    found = {r["id"]: r for r in cands.filter(F.col("id").isin(wanted)).collect()}
    for name, r in runs.items():
        r.add([found[i] for i in designs[name]])


def refit(spark, runs: Mapping[str, Run], grid: Sequence[tuple[float, float, float]]) -> None:
    """Give every run the grid point (lengthscale, outputscale, noise) of the largest marginal
    likelihood of its observations; ties go to the first point, points whose matrix is not
    positive definite fall out, and a run without any keeps what it has."""
    names = list(runs)
    known = [(np.array(r.xs), np.array(r.ys), r.cfg) for r in runs.values()]
    points = [tuple(map(float, g)) for g in grid]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k in pdf["id"]:
                run, point = divmod(int(k), len(points))
                x, y, cfg = known[run]
                ls, os, noise = points[point]
                try:
                    lml = log_marginal_likelihood(x, y, replace(cfg, lengthscale=ls, outputscale=os, noise=noise))
                except np.linalg.LinAlgError:
                    continue
                out.append((run, point, lml))
            yield pd.DataFrame(out, columns=["run", "point", "lml"])

    rows = spark.range(0, len(names) * len(points), 1, min(len(names) * len(points), spark.sparkContext.defaultParallelism))
    best = (rows.mapInPandas(score, "run int, point int, lml double").groupBy("run")
            .agg(F.max_by("point", F.struct("lml", -F.col("point"))).alias("point")).collect())
    for b in best:
        r = runs[names[b["run"]]]
        ls, os, noise = points[b["point"]]
        r.cfg = replace(r.cfg, lengthscale=ls, outputscale=os, noise=noise)


KERNEL_CELLS = 1 << 19  # kernel values of a strip of candidates
LAZY = 64  # best vectors of a run among which the later picks of a greedy batch are sought


def _shared_points(scorers: Sequence[Scorer]) -> list[tuple[GPConfig, np.ndarray, dict[int, np.ndarray]]]:
    """(kernel, distinct train rows of all runs with it, padded to whole tiles of 8; each run's rows among them)."""
    by_cfg: dict[GPConfig, dict[int, list[bytes]]] = {}
    for k, s in enumerate(scorers):
        if s.nei is None:
            by_cfg.setdefault(replace(s.model.cfg, noise=0.0), {})[k] = [row.tobytes() for row in s.model.x]
    out = []
    for cfg, runs in by_cfg.items():
        place = {p: i for i, p in enumerate(dict.fromkeys(p for rows in runs.values() for p in rows))}
        points = np.frombuffer(b"".join(place)).reshape(len(place), -1)
        points = np.vstack([points, np.zeros((-len(points) % 8, points.shape[1]))])
        out.append((cfg, points, {k: np.array([place[p] for p in rows]) for k, rows in runs.items()}))
    return out


def _scores(scorers: Sequence[Scorer], shared: list, x: np.ndarray) -> np.ndarray:
    """Acquisition of every run (rows) and candidate (columns). Kernel values with a train row are taken once
    for all runs that observed it, strip by strip."""
    acq = np.empty((len(scorers), len(x)))
    for k, s in enumerate(scorers):
        if s.nei is not None:
            acq[k] = s(x)
    for cfg, points, runs in shared:
        step = max(256, KERNEL_CELLS // len(points) // 64 * 64)
        for at in range(0, len(x), step):
            part = x[at:at + step]
            ks = cfg.k(part, points)
            for k, own in runs.items():
                acq[k, at:at + step] = scorers[k](part, ks[:, own])
    return acq


def best_rows(cands: DataFrame, scorers: Sequence[Scorer], b: int, distinct: bool = False) -> list[Row]:
    """The b best unseen candidates of every run (ties to the lowest id) with the sum of all
    acquisition values; ``distinct``: of equal vectors only the best. A task keeps b rows per run
    while it reads its share; their number, runs x b per task, is what is shuffled."""
    kind = cands.schema["id"].dataType.simpleString()
    shared = _shared_points(scorers)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame | None] = [None] * len(scorers)
        total = [0.0] * len(scorers)
        known = np.unique(np.concatenate([s.seen for s in scorers]))
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["x"])).reshape(len(pdf), -1)
            ids = pdf["id"].to_numpy()
            code = pd.factorize(pdf["x"])[0] if distinct else None
            met = np.flatnonzero(np.isin(ids, known))  # observed by some run
            scores = _scores(scorers, shared, x)
            for k, s in enumerate(scorers):
                free = np.delete(np.arange(len(ids)), met[np.isin(ids[met], s.seen)])
                if not len(free):
                    continue
                acq = scores[k, free]
                total[k] += float(acq.sum())
                if distinct:
                    order = np.lexsort((ids[free], -acq))
                    top = order[np.sort(np.unique(code[free][order], return_index=True)[1])[:b]]
                    free, acq = free[top], acq[top]
                elif len(free) > b:
                    top = np.flatnonzero(acq >= np.partition(acq, -b)[-b])
                    free, acq = free[top], acq[top]
                here = pdf.iloc[free].assign(acq=acq)
                both = here if kept[k] is None else pd.concat([kept[k], here])
                both = both.sort_values(["acq", "id"], ascending=[False, True])
                kept[k] = (both.drop_duplicates("x") if distinct else both).head(b)
        out = [rows.assign(run_id=s.run_id, total=[t] + [0.0] * (len(rows) - 1))
               for rows, s, t in zip(kept, scorers, total) if rows is not None]
        if out:
            yield pd.concat(out)[["run_id", "id", "x", "y", "acq", "total"]]

    rows = cands.mapInPandas(part, f"run_id string, id {kind}, x binary, y double, acq double, total double")
    if distinct:
        first = F.min(F.struct((-F.col("acq")).alias("less"), "id", "y", "acq")).alias("f")
        rows = rows.groupBy("run_id", "x").agg(first, F.sum("total").alias("total")).select(
            "run_id", "f.id", "x", "f.y", "f.acq", "total")
    w = Window.partitionBy("run_id")
    return (rows.withColumn("pick", F.row_number().over(w.orderBy(F.col("acq").desc(), "id")))
            .withColumn("total", F.sum("total").over(w)).filter(F.col("pick") <= b)
            .orderBy("run_id", "pick").collect())  # runs x b rows


def random_rows(cands: DataFrame, runs: Mapping[str, Run], b: int) -> list[Row]:
    """The b unseen candidates of every run with the lowest md5(seed:step:id)."""
    specs = F.explode(F.array(*[F.struct(
        F.lit(n).alias("run_id"), F.lit(r.seed).alias("seed"), F.lit(len(r.ys)).alias("step"),
        F.array(*[F.lit(i) for i in r.ids]).alias("seen")) for n, r in runs.items()]))
    d = cands.withColumn("s", specs).select("s.*", "id", "x", "y").filter(~F.array_contains("seen", F.col("id")))
    d = d.withColumn("draw", F.md5(F.concat_ws(":", "seed", "step", F.col("id").cast("string")))).drop("seen", "seed", "step")
    return (_lowest_draws(d, b).withColumn("total", F.lit(None).cast("double")).withColumn("acq", F.col("total"))
            .orderBy("run_id", "pick").collect())  # runs x b rows


def _scorer(name: str, r: Run, beta: float, believed: Sequence[Row] = ()) -> Scorer:
    """``believed``: picks of the same batch, taken as observed at their posterior mean; that
    leaves every mean as it is and takes the variance that they would explain."""
    x, y = np.array(r.xs), np.array(r.ys)
    model = fit_gp(x, y, r.cfg)
    seen = list(r.ids)
    if believed:
        more = np.array([np.frombuffer(p["x"]) for p in believed])
        mu, _ = predict_np(model, more)
        model = fit_gp(np.vstack([x, more]), np.append(y, mu), r.cfg, moments=(model.mean, model.scale))
        seen += [p["id"] for p in believed]
    nei = nei_model(model) if r.acquisition == "nei" else None
    return Scorer(name, r.acquisition, model, np.array(seen), float(y.max()), beta, nei)


def _next_in_pool(scorer: Scorer, pool: Sequence[Row], picked: Sequence[Row]) -> Row | None:
    """The best candidate given the picks, if the pool proves it, else None.

    A believed pick leaves every mean and takes variance, so UCB and EI of no candidate rise: outside
    the pool they stay at or below its last, and a copy of a picked vector has that vector's value."""
    acq = scorer(np.array([np.frombuffer(r["x"]) for r in pool]))
    taken = {p["x"] for p in picked}
    bound = max([pool[-1]["acq"] if len(pool) >= LAZY else -np.inf] + [a for a, r in zip(acq, pool) if r["x"] in taken])
    free = [(-a, r["id"], r) for a, r in zip(acq, pool) if r["x"] not in taken]
    best = min(free, key=lambda f: f[:2], default=None)
    return best[2] if best is not None and -best[0] > bound + 1e-6 * scorer.model.scale else None


def greedy_rows(cands: DataFrame, runs: Mapping[str, Run], b: int, beta: float) -> tuple[dict[str, list[Row]], dict]:
    """Greedy batches: a pass brings the ``LAZY`` best vectors of each run, and picks are made
    among them as long as no other candidate can be better; then the runs left take another pass."""
    picks: dict[str, list[Row]] = {n: [] for n in runs}
    sums: dict[str, float | None] = {n: None for n in runs}
    left = dict(runs)
    while left:
        found: dict[str, list[Row]] = {}
        for row in best_rows(cands, [_scorer(n, r, beta, picks[n]) for n, r in left.items()], LAZY, distinct=True):
            found.setdefault(row["run_id"], []).append(row)
        for n, pool in found.items():
            if not picks[n]:
                sums[n] = pool[0]["total"]
            nxt = pool[0]
            while nxt is not None:
                picks[n].append(nxt)
                provable = len(picks[n]) < b and runs[n].acquisition in ("ucb", "ei")
                nxt = _next_in_pool(_scorer(n, runs[n], beta, picks[n]), pool, picks[n]) if provable else None
        left = {n: r for n, r in left.items() if n in found and len(picks[n]) < b}
    return picks, sums


def choose(cands: DataFrame, runs: Mapping[str, Run], b: int, batch: str, beta: float) -> tuple[dict[str, list[Row]], dict]:
    """(picks, acquisition sum) of every run. ``top`` takes the b best of one scoring; ``greedy``
    scores anew after each pick, given the picks before it."""
    scored = {n: r for n, r in runs.items() if r.acquisition != "random"}
    drawn = {n: r for n, r in runs.items() if r.acquisition == "random"}
    picks: dict[str, list[Row]] = {n: [] for n in runs}
    sums: dict[str, float | None] = {n: None for n in runs}
    if scored and batch == "greedy":
        found, totals = greedy_rows(cands, scored, b, beta)
        picks |= found
        sums |= totals
    elif scored:
        for row in best_rows(cands, [_scorer(n, r, beta) for n, r in scored.items()], b):
            picks[row["run_id"]].append(row)
            sums[row["run_id"]] = row["total"]
    if drawn:
        for row in random_rows(cands, drawn, b):
            picks[row["run_id"]].append(row)
    return picks, sums


def run_sweep(cands: DataFrame, id_col: str, features: str, y: str, runs: Mapping[str, Mapping],
              n_init: int, n_iters: int, cfg: GPConfig = GPConfig(), beta: float = 0.1, b: int = 1,
              batch: str = "top", grid: Sequence[tuple[float, float, float]] | None = None,
              designs: Mapping[str, Sequence] | None = None) -> list[Step]:
    """G13 (G11 is one run): every run observes its initial design and then, ``n_iters`` times,
    refits, scores all candidates it has not observed, and observes the ``b`` it picks.

    ``runs``: run_id -> {"seed": int, "acquisition": "ucb" | "ei" | "nei" | "random"}. The
    design of a run is its ``n_init`` lowest md5(seed:id) draws, or the ids ``designs`` gives.
    ``grid``: (lengthscale, outputscale, noise) points; the best one by marginal likelihood is
    taken before every step (runs that pick at random skip that). Without a grid ``cfg`` stays.
    ``batch``: the b best of one scoring ("top"), or one after the other, each given those
    before ("greedy"). A run that has observed every candidate stops.
    """
    state = {n: Run(c.get("acquisition", "ucb"), c.get("seed", 0), cfg) for n, c in runs.items()}
    unknown = {r.acquisition for r in state.values()} - ACQUISITIONS
    if unknown:
        raise ValueError(f"unknown acquisition {sorted(unknown)}; choose from {sorted(ACQUISITIONS)}")
    if batch not in BATCHES:
        raise ValueError(f"unknown batch '{batch}'; choose from {sorted(BATCHES)}")
    packed = pack_candidates(cands, id_col, features, y)
    if designs is None:
        initial_designs(packed, state, n_init)
    else:
        given_designs(packed, state, designs)
    trace = []
    for it in range(n_iters):
        fitted = {n: r for n, r in state.items() if r.acquisition != "random"}
        if grid and fitted:
            refit(cands.sparkSession, fitted, grid)
        picks, sums = choose(packed, state, b, batch, beta)
        for n, r in state.items():
            if picks[n]:
                trace.append(Step(n, it, max(r.ys), picks[n][0]["id"], max(p["y"] for p in picks[n]), sums[n],
                                  [p["id"] for p in picks[n]], r.cfg.lengthscale, r.cfg.outputscale, r.cfg.noise))
                r.add(picks[n])
    return trace


def optimise(cands: DataFrame, id_col: str, features: str, y: str, n_init: int, n_iters: int,
             acquisition: str = "ucb", seed: int = 0, cfg: GPConfig = GPConfig(), beta: float = 0.1, **options) -> list[Step]:
    """One campaign; the trace logs best-so-far, suggestion and acquisition sum per iteration."""
    return run_sweep(cands, id_col, features, y, {"run": {"seed": seed, "acquisition": acquisition}},
                     n_init, n_iters, cfg, beta, **options)
