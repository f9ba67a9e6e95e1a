"""Embedding whitening by shifted CholeskyQR.

The centred rows Z stay where they are. A pass solves Z against the triangular factors found
so far, sums the Gram matrix of the result over all tasks, and takes its Cholesky factor as
the next one: the first shifted, so that an ill-conditioned Z can't break it, the others to
bring Q to orthogonality. R, the product of the factors, has the singular values and the
right singular vectors of Z; from its SVD come the components and the scale of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.vectors import lists, matrix, scaled_floor, usable

EPS = np.finfo(np.float64).eps / 2
SUMMED = 8192  # rows that one product adds up before the sums are added pairwise
PASSES = 10  # a table of full rank takes three; more are only needed next to rank deficiency
LONG_MAX = (1 << 63) - 1


@dataclass
class Centre:
    """Rows, and per dimension floor(mean) and n * mean - n * floor(mean), all exact."""
    n: int
    low: np.ndarray
    rest: np.ndarray
    wide: bool

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        y = x - self.low
        if self.wide:
            return self.n * y.astype(object) - self.rest.astype(object)
        return self.n * y - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (self.times_n(x) / self.n).astype(np.float64)


def solve_rows(z: np.ndarray, r: np.ndarray) -> np.ndarray:
    """z R^-1 for an upper triangular R, column by column."""
    q = np.empty_like(z)
    for j in range(z.shape[1]):
        q[:, j] = (z[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


def shifted_cholesky(g: np.ndarray, first: bool) -> np.ndarray:
    """Upper triangular factor of the Gram matrix plus a shift.

    The first shift covers the rounding of the sums, 11 (m d + d (d + 1)) u ||G||; the later
    ones only what keeps a singular matrix positive.
    """
    d = len(g)
    lam = np.linalg.eigvalsh(g)
    top = max(float(lam[-1]), np.finfo(np.float64).tiny)
    if first:
        shift = 11 * (SUMMED * d + d * (d + 1)) * EPS * top
    else:
        shift = 0.0 if lam[0] > 0.1 * top else 16 * d * EPS * top
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(d)).T.copy()
        except np.linalg.LinAlgError:
            shift = max(10 * shift, EPS * top)


def _sum_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("task")  # the same sum however the rows arrive
    total = np.stack([np.frombuffer(b) for b in pdf["row"]]).sum(0)
    return pd.DataFrame([{"i": pdf["i"].iloc[0], "row": total.tobytes()}])


def _gram(src: DataFrame, dim: int, width: int, of) -> tuple[np.ndarray, np.ndarray]:
    """(column sums, Gram matrix) of the rows ``of(vectors)``: d x d numbers per task, added up by row."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width + 1, width))
        for batch in batches:
            q = of(matrix(batch, "vec", dim))
            for i in range(0, len(q), SUMMED):
                part = q[i:i + SUMMED]
                g[:width] += part.T @ part
                g[width] += part.sum(0)
        yield pa.RecordBatch.from_pydict({
            "i": pa.array(range(width + 1), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * (width + 1), pa.int32()),
            "row": pa.array([r.tobytes() for r in g], pa.binary())})

    found = (src.select("vec").mapInArrow(partial, "i int, task int, row binary")
             .groupBy("i").applyInPandas(_sum_rows, "i int, row binary").collect())  # width + 1 rows
    g = np.zeros((width + 1, width))
    for r in found:
        g[r["i"]] = np.frombuffer(r["row"])
    return g[width], (g[:width] + g[:width].T) / 2


def fit_centre(src: DataFrame, dim: int, n: int, scale: float, offset: int) -> Centre:
    """Exact sums per dimension."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, lo, hi = np.zeros(dim, object), np.full(dim, LONG_MAX), np.full(dim, -LONG_MAX)
        for batch in batches:
            x = scaled_floor(matrix(batch, "vec", dim), scale) + offset
            if len(x):
                far = int(np.abs(x).max()) * len(x) > LONG_MAX
                s += x.astype(object).sum(0) if far else x.sum(0)
                lo, hi = np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0))
        yield pa.RecordBatch.from_pydict({"j": pa.array(range(dim), pa.int32()), "lo": pa.array(lo, pa.int64()),
                                          "hi": pa.array(hi, pa.int64()),
                                          "s": pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))})

    rows = (src.select("vec").mapInArrow(partial, "j int, lo long, hi long, s decimal(38,0)").groupBy("j")
            .agg(F.sum("s").alias("s"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("j").collect())
    low = [int(r["s"]) // n for r in rows]
    rest = [int(r["s"]) - n * m for r, m in zip(rows, low)]
    most = max(max(abs(r["lo"] - m), abs(r["hi"] - m)) + 1 for r, m in zip(rows, low))
    return Centre(n, np.array(low, np.int64), np.array(rest, np.int64), dim * (n * most) ** 2 > LONG_MAX)


@dataclass
class Whitening:
    """A fitted whitening: rows (x - mean) times ``project`` are white; dead components are NaN."""
    centre: Centre
    components: np.ndarray  # dims x components, unit vectors
    project: np.ndarray
    explained: np.ndarray
    identity_error: float | None


def fit_whitening(src: DataFrame, dim: int, n: int, components: int, scale: float, offset: int) -> Whitening:
    centre = fit_centre(src, dim, n, scale, offset)
    centred = lambda vec: centre.rows(scaled_floor(vec, scale) + offset)
    factors: list[np.ndarray] = []
    total = np.eye(dim)
    z_sum = None
    for _ in range(PASSES):
        def q(vec: np.ndarray, factors: tuple = tuple(factors)) -> np.ndarray:
            out = centred(vec)
            for r in factors:
                out = solve_rows(out, r)
            return out

        sums, g = _gram(src, dim, dim, q)
        z_sum = sums if z_sum is None else z_sum
        if not g.any():
            total = np.zeros((dim, dim))
            break
        r = shifted_cholesky(g, first=not factors)
        before, total = total, r @ total
        if factors:
            u, s, _ = np.linalg.svd(before)
            live = u[:, s > _least(s, dim)]
            if np.abs(live.T @ g @ live - np.eye(live.shape[1])).max(initial=0.0) < 64 * dim * EPS:
                break
        factors.append(r)
    _, s, vt = np.linalg.svd(total)
    c = min(components, dim)
    v = vt[:c].T
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(c)])  # the largest entry is positive
    alive = s[:c] > _least(s, dim)
    size = np.where(alive, s[:c], np.nan)
    project = v * (np.sqrt(n) / size)
    power = float((s * s).sum())
    explained = s[:c] ** 2 / power if power > 0 else np.full(c, np.nan)
    some = int(alive.sum())  # singular values fall, so the first ones
    error = None
    if some:
        p = project[:, :some]
        mean = z_sum / n @ p
        _, cov = _gram(src, dim, some, lambda vec: centred(vec) @ p - mean)
        error = float(np.abs(cov / n - np.eye(some)).max())
    return Whitening(centre, v, project, explained, error)


def _least(s: np.ndarray, dim: int) -> float:
    """Singular values up to here are rounding: the direction has no variance."""
    return float(s[0]) * 16 * dim * EPS if len(s) else 0.0


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32,
           scale: float = 64.0, offset: int = 1_000_000) -> DataFrame:
    """One row per usable vector: id, n, deviation, whitened array<double>, explained array<double>, identity_error.

    x = floor(scale * entry) + offset. whitened holds the coordinates of x - mean along the
    first ``components`` unit eigenvectors of the covariance (divisor n, falling eigenvalue),
    each over the square root of its eigenvalue; explained the eigenvalues over their sum;
    identity_error how far the covariance of whitened is from the identity, from a pass of its
    own; deviation is the exact sum of (n x - S)^2.

    Rows whose vector is null, empty, holds null or non-finite entries or some beyond 62 bits
    after scaling, or has another length than most (ties: the longer) are dropped. A component
    without variance (constant or dependent dimensions, fewer rows than dimensions) has null
    in whitened and stays out of identity_error; if no component has any, explained is null
    too. A deviation beyond a long is null. Repeated rows and ids count as rows of their own.
    Other columns are ignored; an empty table gives an empty one.

    Every pass is one scan whose tasks each send a d x d matrix, added up by matrix row; the
    vectors themselves are never shuffled, and a lost task only repeats its own scan.
    """
    d = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
    src, n, dim = usable(d, "v", scale, ["id"])
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    if n == 0:
        return vectors.sparkSession.createDataFrame([], schema)
    fit = fit_whitening(src, dim, n, components, scale, offset)
    c, centre, project, error = len(fit.explained), fit.centre, fit.project, fit.identity_error
    explained = None if np.isnan(fit.explained).any() else fit.explained

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_rows
            if not k:
                continue
            x = scaled_floor(matrix(batch, "vec", dim), scale) + offset
            dev = (centre.times_n(x) ** 2).sum(1)
            dev = [int(v) if v <= LONG_MAX else None for v in dev] if centre.wide else dev
            ex = np.full((k, c), np.nan) if explained is None else np.tile(explained, (k, 1))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column(0), "n": pa.array([n] * k, pa.int64()), "deviation": pa.array(dev, pa.int64()),
                "whitened": lists(centre.rows(x) @ project, pa.float64()), "explained": lists(ex, pa.float64()),
                "identity_error": pa.array([error] * k, pa.float64())})

    return src.select("id", "vec").mapInArrow(apply, schema)
