"""The optimisation loop, its refits, batches and noisy improvement, against direct linear algebra."""

import itertools
import math

import numpy as np
import pytest

from platewise.operators import loop as L
from platewise.operators import surrogate as GP
from platewise.operators.design import init_random

GRID = [(l, o, n) for l in (0.3, 0.8, 2.0) for o in (0.5, 2.0) for n in (1e-4, 1e-2)]


@pytest.fixture(scope="module")
def plate(spark):
    rng = np.random.default_rng(4)
    xs = rng.normal(size=(60, 4)) * 0.5
    ys = np.sin(3 * xs[:, 0]) - xs[:, 1] ** 2 + 0.05 * rng.normal(size=60)
    df = spark.createDataFrame([(i, xs[i].tolist(), float(ys[i]), "x") for i in range(60)],
                               "id long, feats array<double>, y double, kernel string").repartition(3).cache()
    return df, xs, ys


def kernel(a, b, ls, os):
    r = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)) / ls
    return os * (1 + math.sqrt(5) * r + 5 / 3 * r * r) * np.exp(-math.sqrt(5) * r)


def posterior(xs, seen, y, ls, os, noise, m, s):
    """Joint posterior of every row by a plain inverse."""
    inv = np.linalg.inv(kernel(xs[seen], xs[seen], ls, os) + noise * np.eye(len(seen)))
    ks = kernel(xs, xs[seen], ls, os)
    return m + s * ks @ inv @ ((y - m) / s), s * s * (kernel(xs, xs, ls, os) - ks @ inv @ ks.T)


def likelihood(xs, y, ls, os, noise):
    ys = (y - y.mean()) / y.std(ddof=1)
    k = kernel(xs, xs, ls, os) + noise * np.eye(len(y))
    return -0.5 * ys @ np.linalg.solve(k, ys) - 0.5 * np.linalg.slogdet(2 * math.pi * k)[1]


def slow_loop(xs, ys, seen, steps, grid, b, batch, beta=0.1, cfg=GP.GPConfig()):
    """Refit in full, invert in full, one step after the other; a greedy batch conditions the joint covariance."""
    seen, out = list(seen), []
    for _ in range(steps):
        y = ys[seen]
        hyper = (cfg.lengthscale, cfg.outputscale, cfg.noise)
        if grid:
            hyper = max(grid, key=lambda g: (likelihood(xs[seen], y, *g), -grid.index(g)))
        m, s = y.mean(), y.std(ddof=1)
        mu, cov = posterior(xs, seen, y, *hyper, m, s)
        free = [i for i in range(len(xs)) if i not in seen]
        picked, total = [], None
        for _ in range(b if batch == "greedy" else 1):
            acq = {i: mu[i] + math.sqrt(beta * max(cov[i, i], 0.0)) for i in free if i not in picked}
            total = sum(acq.values()) if total is None else total
            best = sorted(acq, key=lambda i: (-acq[i], i))
            if batch == "greedy":
                t = best[0]
                picked.append(t)
                cov = cov - np.outer(cov[:, t], cov[t]) / (cov[t, t] + s * s * hyper[2])
            else:
                picked = best[:b]
        out.append((picked, hyper, total, y.max()))
        seen += picked
    return out


@pytest.mark.parametrize("grid,b,batch", [(None, 1, "top"), (GRID, 1, "top"), (GRID, 4, "top"), (GRID, 4, "greedy")])
def test_campaign_equals_full_refits_and_conditioning(spark, plate, grid, b, batch):
    df, xs, ys = plate
    start = init_random(df, "id", 6, 3)
    got = L.optimise(df, "id", "feats", "y", 6, 6, "ucb", seed=3, grid=grid, b=b, batch=batch)
    for step, (picked, hyper, total, best) in zip(got, slow_loop(xs, ys, start, 6, grid, b, batch), strict=True):
        assert step.picked == picked and step.suggestion_id == picked[0]
        assert (step.lengthscale, step.outputscale, step.noise) == hyper
        assert abs(step.acq_sum - total) < 1e-6 and abs(step.best_so_far - best) < 1e-12
        assert step.suggestion_y == max(ys[picked])


def test_a_greedy_batch_takes_one_pass_unless_copies_could_win(spark, plate, monkeypatch):
    df, xs, ys = plate
    passes, plain = [], L.best_rows
    monkeypatch.setattr(L, "best_rows", lambda *a, **k: passes.append(1) or plain(*a, **k))
    kw = dict(acquisition="ei", seed=3, b=4, batch="greedy")
    got = L.optimise(df, "id", "feats", "y", 6, 3, **kw)
    assert len(passes) == 3 and L.pack_candidates(df.coalesce(1), "id", "feats", "y").rdd.getNumPartitions() > 1
    copies = df.unionAll(df.selectExpr("id + 1000", "feats", "y", "kernel")).unionAll(df.selectExpr("id + 2000", "feats", "y", "kernel"))
    monkeypatch.setattr(L, "LAZY", 2)  # a pool that proves little
    start = init_random(df, "id", 6, 3)
    few = L.run_sweep(copies, "id", "feats", "y", {"run": {"seed": 3, "acquisition": "ei"}}, 6, 3, b=4, batch="greedy", designs={"run": start})
    monkeypatch.setattr(L, "_next_in_pool", lambda *a: None)  # a pass per pick
    assert [t.picked for t in few] == [t.picked for t in L.run_sweep(
        copies, "id", "feats", "y", {"run": {"seed": 3, "acquisition": "ei"}}, 6, 3, b=4, batch="greedy", designs={"run": start})]
    assert [t.picked for t in got] == [t.picked for t in L.optimise(df, "id", "feats", "y", 6, 3, **kw)]


def test_runs_of_a_sweep_do_not_touch_each_other(spark, plate):
    df, xs, ys = plate
    runs = {f"{a}{s}": {"seed": s, "acquisition": a} for a in ("ucb", "ei", "nei", "random") for s in (1, 2)}
    together = L.run_sweep(df, "id", "feats", "y", runs, 5, 3, grid=GRID[:4])
    for name in ("ei2", "nei1", "random2"):
        alone = L.run_sweep(df, "id", "feats", "y", {name: runs[name]}, 5, 3, grid=GRID[:4])
        assert [t for t in together if t.run_id == name] == alone
    assert all((t.acq_sum is None) == t.run_id.startswith("random") for t in together) and len(together) == 24


def test_given_designs_linear_kernels_and_exhausted_runs(spark, plate):
    df, xs, ys = plate
    few = df.filter("id < 9")
    got = L.run_sweep(few, "id", "feats", "y", {"a": {}, "r": {"acquisition": "random"}}, 0, 9,
                      cfg=GP.GPConfig(kernel="linear+matern25"), b=2, designs={"a": [8, 3], "r": [0]})
    for run, first in (("a", [8, 3]), ("r", [0])):
        mine = [t for t in got if t.run_id == run]
        assert sorted(first + [i for t in mine for i in t.picked]) == list(range(9))
        assert all(p not in first for t in mine for p in t.picked)


def test_rows_that_cannot_be_scored_are_left_out(spark, plate):
    df, xs, ys = plate
    bad = spark.createDataFrame([(100, None, 1.0, "x"), (101, [1.0, None, 0.0, 0.0], 1.0, "x"), (None, [0.0] * 4, 1.0, "x"),
                                 (102, [0.0] * 4, None, "x"), (103, [float("nan")] * 4, 9.0, "x")], df.schema)
    a = L.optimise(df.unionAll(bad), "id", "feats", "y", 6, 4, "ei", seed=1)
    assert a == L.optimise(df, "id", "feats", "y", 6, 4, "ei", seed=1)


def test_unknown_batch_is_an_error(spark, plate):
    with pytest.raises(ValueError, match="unknown batch"):
        L.optimise(plate[0], "id", "feats", "y", 2, 1, batch="some")


def test_noisy_improvement_conditions_a_model_on_every_draw():
    rng = np.random.default_rng(9)
    x, y, q = rng.normal(size=(7, 3)), rng.normal(size=7), rng.normal(size=(20, 3))
    model = GP.fit_gp(x, y, GP.GPConfig(noise=0.05))
    got = GP.nei_model(model, 30)(q)
    z = GP.halton_normals(30, 7)
    k = model.cfg.k(x, x)
    inv = np.linalg.inv(k + 0.05 * np.eye(7))
    mu, cov = k @ inv @ ((y - model.mean) / model.scale), k - k @ inv @ k + GP.NEI_JITTER * np.eye(7)
    want = np.zeros(20)
    for s in range(30):
        f = mu + np.linalg.cholesky(cov) @ z[s]
        free = np.linalg.inv(k + GP.NEI_NOISE * np.eye(7))
        kq = model.cfg.k(q, x)
        m = model.mean + model.scale * kq @ free @ f
        sd = model.scale * np.sqrt(np.maximum(2.0 - np.einsum("ij,jk,ik->i", kq, free, kq), 0))
        u = (m - (model.mean + model.scale * f.max())) / sd
        phi = np.exp(-u * u / 2) / math.sqrt(2 * math.pi)
        want += sd * (u * np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in u]) + phi) / 30
    assert np.allclose(got, want, atol=1e-5)


def test_halton_table_has_normal_columns():
    z = GP.halton_normals(2000, 12)
    assert z.shape == (2000, 12) and np.abs(z.mean(0)).max() < 0.05 and np.abs(z.std(0) - 1).max() < 0.05
    assert GP.radical_inverse(6, 2) == 0.375 and GP.halton_normals(3, 5).shape == (3, 5)
    assert GP._primes(60)[-1] == 281


def test_numpy_improvement_equals_the_column(spark):
    from pyspark.sql import functions as F

    from platewise.functions.normal import np_ei
    from platewise.operators.acquire import ei

    rows = [(m, v) for m, v in itertools.product((-30.0, -4.2, -1.0, 0.0, 2.0), (0.0, 1e-4, 1.0, 9.0))]
    df = spark.createDataFrame(rows, "mu double, var double").select("mu", "var", ei("mu", "var", 0.5).alias("e"))
    got = df.collect()
    mine = np_ei(np.array([r["mu"] for r in got]), np.array([r["var"] for r in got]), 0.5)
    assert np.allclose(mine, [r["e"] for r in got], rtol=1e-9, atol=1e-300)
