"""Vector code compression: product codes whose codebooks come from ball k-means.

An entry and the parts assigned to it form a ball: the entry is its centre, the farthest part
its radius. Only entries within twice the radius can take a part away, so these are its
neighbours. A part closer to its entry than half the way to the nearest neighbour lies in the
stable core and is not looked at; any other lies in a ring that names the neighbours (nearest
first) that are compared. A ball that stands still among neighbours that stand still is
skipped as a whole. All arithmetic that decides is on integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import stage, unstage
from platewise.llm.vectors import lists, matrix, scaled_floor, usable
from platewise.operators.ordered import small_side

ROWS = 2048  # rows of a batch that are compared with a whole codebook at once
SAFE = 1 + 1e-9  # margin of the radii, which are doubles, over rounding
LONG_MAX = (1 << 63) - 1


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of book, exact in the arrays' type."""
    return (x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)[None]


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of the nearest entry of each row, ties to the lower index; every entry is compared."""
    found = [squares(x[i:i + ROWS], book).argmin(1) for i in range(0, len(x), ROWS)]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Balls:
    """One part position: its entries, and around each entry its neighbours, nearest first."""
    book: np.ndarray
    ids: list[np.ndarray]
    gaps: list[np.ndarray]
    still: np.ndarray


def make_balls(old: np.ndarray, book: np.ndarray, far: np.ndarray) -> Balls:
    """``far``: greatest distance of an entry's parts to the old entry, -1 if it has none."""
    moved = np.sqrt(((book - old) ** 2).sum(1).astype(np.float64))
    gaps = squares(book, book)
    ids, kept, still = [], [], np.zeros(len(book), bool)
    for e, (radius, step) in enumerate(zip(far, moved)):
        reach = (2 * (radius + step) * SAFE) ** 2 if radius >= 0 else -1.0
        near = np.array([j for j in np.flatnonzero(gaps[e].astype(np.float64) <= reach) if j != e], np.int64)
        near = near[np.lexsort((near, gaps[e][near].astype(np.float64)))]
        ids.append(near)
        kept.append(gaps[e][near])
        still[e] = step == 0 and not moved[near].any()
    return Balls(book, ids, kept, still)


def reassign(x: np.ndarray, now: np.ndarray, balls: Balls) -> np.ndarray:
    """The nearest entry of each row, as ``nearest`` gives it, from the entries of the round before."""
    out = now.copy()
    order = np.argsort(now, kind="stable")
    ends = np.flatnonzero(np.diff(now[order])) + 1
    for rows in np.split(order, ends) if len(order) else []:
        e = int(now[rows[0]])
        ids, gaps = balls.ids[e], balls.gaps[e]
        if balls.still[e] or not len(ids):
            continue
        own = ((x[rows] - balls.book[e]) ** 2).sum(1)
        ring = np.searchsorted(gaps, 4 * own, side="right")  # neighbours that are not provably farther
        width = 1
        while width < 2 * len(ids):
            here = (ring > width // 2) & (ring <= width)
            if here.any():
                some, d = ids[:width], squares(x[rows[here]], balls.book[ids[:width]])
                least = d.min(1)
                best = np.where(d == least[:, None], some[None], len(balls.book)).min(1)
                won = (least < own[here]) | ((least == own[here]) & (best < e))
                out[rows[here]] = np.where(won, best, e)
            width *= 2
    return out


def _cuts(dim: int, parts: int) -> list[int]:
    """Ends of the parts; a length that doesn't divide gives the first parts one more entry."""
    size, more = divmod(dim, parts)
    return [0, *np.cumsum([size + (p < more) for p in range(parts)]).tolist()]


def _exact(x: np.ndarray, wide: bool) -> np.ndarray:
    """float64 where every sum of squares stays below 2^53, else Python integers."""
    return x.astype(object) if wide else x.astype(np.float64)


def learn_codes(vectors: DataFrame, id_col: str, vec_col: str, keep: list[str], parts: int, entries: int, rounds: int,
                scale: float) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows ``keep``, x array<long>, a array<int> as of the last round, codes array<int>, error decimal; codebooks)."""
    src, n, dim = usable(vectors, vec_col, scale, keep)
    fields = ", ".join(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in keep)
    if n == 0:
        return vectors.sparkSession.createDataFrame([], f"{fields}, codes array<int>, error decimal(38,0)"), []
    cut = _cuts(dim, parts)
    v = F.transform("vec", lambda c: F.floor(c * F.lit(float(scale))))
    x0 = src.select(*keep, v.alias("x"))
    top = x0.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("m")).first()["m"]
    wide = dim * (2 * top) ** 2 >= 1 << 52
    first = (x0.select(F.col(id_col), "x").orderBy(F.col(id_col).isNull(), id_col, "x").limit(entries)).collect()
    books = [_exact(np.array([r["x"][a:b] for r in first], np.int64), wide) for a, b in zip(cut, cut[1:])]

    def cols(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        x = matrix(batch, "x", dim)
        return x, [_exact(x[:, a:b], wide) for a, b in zip(cut, cut[1:])]

    def kept(batch: pa.RecordBatch) -> dict:
        return {k: batch.column(batch.schema.get_field_index(k)) for k in keep}

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = scaled_floor(matrix(batch, "vec", dim), scale)
                a = np.stack([nearest(_exact(x[:, i:j], wide), book) for i, j, book in zip(cut, cut[1:], books)], 1)
                yield pa.RecordBatch.from_pydict(kept(batch) | {"x": lists(x, pa.int64()), "a": lists(a, pa.int32())})

    def totals(state: DataFrame, books: list[np.ndarray]) -> list[dict]:
        """Per part and used entry: parts, greatest distance, sum of each position."""
        widest = max(b - a for a, b in zip(cut, cut[1:]))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = [np.zeros(len(b), np.int64) for b in books]
            far = [np.full(len(b), -1.0) for b in books]
            sums = [np.zeros(b.shape, object) for b in books]
            for batch in batches:
                _, xs = cols(batch)
                a = matrix(batch, "a", parts)
                for p, x in enumerate(xs):
                    at = a[:, p]
                    n[p] += np.bincount(at, minlength=len(n[p]))
                    d = np.sqrt(((x - books[p][at]) ** 2).sum(1).astype(np.float64))
                    np.maximum.at(far[p], at, d)
                    add = np.zeros(books[p].shape, x.dtype)
                    np.add.at(add, at, x)
                    sums[p] += add if wide else add.astype(np.int64)
            used = [(p, e) for p in range(parts) for e in np.flatnonzero(n[p])]
            if used:
                whole = [[Decimal(int(s)) for s in sums[p][e]] + [Decimal(0)] * (widest - sums[p].shape[1]) for p, e in used]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([p for p, _ in used], pa.int32()), "entry": pa.array([int(e) for _, e in used], pa.int32()),
                    "n": pa.array([int(n[p][e]) for p, e in used], pa.int64()),
                    "far": pa.array([float(far[p][e]) for p, e in used], pa.float64()),
                    "s": pa.array(whole, pa.list_(pa.decimal128(38, 0)))})

        rows = state.select("x", "a").mapInArrow(partial, "part int, entry int, n long, far double, s array<decimal(38,0)>")
        return rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.max("far").alias("far"), *[
            F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(widest)]).collect()  # at most parts * entries rows

    def closer(balls: list[Balls]):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, xs = cols(batch)
                    now = matrix(batch, "a", parts)
                    a = np.stack([reassign(part, now[:, p], balls[p]) for p, part in enumerate(xs)], 1)
                    yield pa.RecordBatch.from_pydict(kept(batch) | {"x": lists(x, pa.int64()), "a": lists(a, pa.int32())})
        return step

    def finish(balls: list[Balls]):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    _, xs = cols(batch)
                    now = matrix(batch, "a", parts)
                    a = [reassign(part, now[:, p], balls[p]) for p, part in enumerate(xs)]
                    err = sum(((part - balls[p].book[a[p]]) ** 2).sum(1).astype(object if wide else np.int64)
                              for p, part in enumerate(xs))
                    err = pa.array([Decimal(int(e)) for e in err], pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_pydict(kept(batch) | {"codes": lists(np.stack(a, 1), pa.int32()), "error": err})
        return step

    schema = f"{fields}, x array<long>, a array<int>"
    state = stage(src.mapInArrow(start, schema))
    for r in range(rounds):
        new, far = [b.copy() for b in books], [np.full(len(b), -1.0) for b in books]
        for t in totals(state, books):
            p, e = t["part"], t["entry"]
            new[p][e] = [int(t[f"s{k}"]) // t["n"] for k in range(new[p].shape[1])]
            far[p][e] = t["far"]
        balls = [make_balls(old, book, f) for old, book, f in zip(books, new, far)]
        books = new
        if r + 1 < rounds:
            before, state = state, stage(state.mapInArrow(closer(balls), schema))
            unstage(before)
    if not rounds:
        balls = [make_balls(b, b, np.full(len(b), np.inf)) for b in books]
    out = stage(state.mapInArrow(finish(balls), f"{fields}, codes array<int>, error decimal(38,0)"))
    unstage(state)
    return out, books


def book_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(int(c)) for b in books for row in b for c in row).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0) -> DataFrame:
    """One row per usable vector: id, label, code, error, label_error, codebooks_sha256.

    Components become floor(scale * c); vectors are cut into ``parts`` consecutive parts. The
    codebook of a position starts as that part of the ``entries`` smallest ids (null ids last,
    ties by vector); each round assigns every part to its nearest entry and moves every used
    entry to the componentwise floor of its parts' mean; a last assignment gives the code.

    Rows whose vector is null, empty, holds null or non-finite entries or some beyond 62 bits
    after scaling, or has another length than most (ties: the longer) are dropped. A length
    that ``parts`` does not divide gives the first parts one entry more. Fewer vectors than
    ``entries`` give smaller codebooks; repeated rows and ids are vectors of their own. Null
    labels are one label. Sums of errors beyond a long give null. Other columns are ignored;
    an empty table gives an empty one.

    A round is one narrow pass over the vectors and an aggregate of at most parts * entries
    rows per task; the driver holds the codebooks and their neighbours, bounded by
    parts * entries^2. The table of a round replaces that of the round before.
    """
    d = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    coded, books = learn_codes(d, "id", "vec", ["id", "label"], parts, entries, rounds, scale)
    digits = max(2, len(f"{entries - 1:x}"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")))
    fits = lambda c: F.when(c <= F.lit(LONG_MAX), c).cast("bigint")
    sums = small_side(coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("sum")))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("l"))).select(
        "id", "label", code.alias("code"), fits(F.col("error")).alias("error"), fits(F.col("sum")).alias("label_error"),
        F.lit(book_digest(books)).alias("codebooks_sha256"))
