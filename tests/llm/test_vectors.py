"""Whitening, vector codes and shards, each against a plain brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm.ball_codes import book_digest, compress, make_balls, nearest, reassign
from platewise.llm.kd_shards import assign_shards, write_shards
from platewise.llm.qr_whiten import shifted_cholesky, solve_rows, whiten


@pytest.fixture
def vecs(spark):
    """Builds an embeddings table, with columns whose names clash with the operators' own."""
    def make(rows, kind="float", parts=3):
        full = [(i, v, lab, 9, 1.5, "c") for i, v, lab in rows]
        return spark.createDataFrame(full, f"vec_id bigint, embedding array<{kind}>, label int, n int, x double, code string"
                                     ).repartition(parts)

    return make


BAD = [(900, None, 1), (901, [1.0, None, 0.0, 0.0], 1), (902, [float("nan"), 0.0, 0.0, 0.0], 1),
       (903, [float("inf"), 0.0, 0.0, 0.0], 1), (904, [], 2), (905, [1.0, 2.0], 2), (906, [1e300, 0.0, 0.0, 0.0], None)]


def random_rows(n, dim, seed, spread=1.0):
    r = random.Random(seed)
    return [(i * 3, [r.gauss(0, spread) for _ in range(dim)], r.choice([1, 2, None])) for i in range(n)]


# ---- whitening ---------------------------------------------------------------------

def white_oracle(rows, c):
    x = np.array([[math.floor(64 * a) + 1_000_000 for a in v] for _, v, _ in rows], dtype=object)
    n, s = len(x), x.sum(0)
    z = ((n * x - s) / n).astype(float)
    _, sv, vt = np.linalg.svd(z, full_matrices=False)
    lam = sv ** 2 / n
    return ((n * x - s) ** 2).sum(1), z @ vt[:c].T / np.sqrt(lam[:c]), lam[:c] / lam.sum()


def check_white(out, rows, c, tol=1e-8):
    dev, white, share = white_oracle(rows, c)
    got = {}
    for r in out.collect():
        got.setdefault(r["id"], []).append(r)
    w = np.array([got[i][0]["whitened"] for i, _, _ in rows])
    sign = np.sign((w * white).sum(0))
    assert np.abs(w * sign - white).max() < tol
    for (i, _, _), d in zip(rows, dev):
        assert got[i][0]["deviation"] == (d if d < 2 ** 63 else None) and got[i][0]["n"] == len(rows)
        assert np.allclose(got[i][0]["explained"], share, rtol=max(1e-9, tol)) and got[i][0]["identity_error"] < max(1e-9, tol)


def test_whitening_matches_singular_vectors(vecs):
    rows = [(i, [a * (k + 1) for k, a in enumerate(v)], lab) for i, v, lab in random_rows(300, 6, 1)]
    bad = [(i, v and [*v, *[0.0] * (6 - len(v))] if v else v, lab) for i, v, lab in BAD if i != 905]
    out = whiten(vecs(rows + bad, "double"), components=4)
    assert out.columns == ["id", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 300
    check_white(out, rows, 4)


def test_whitening_of_an_ill_conditioned_table(vecs):
    r = random.Random(4)
    rows = []
    for i in range(400):
        a, b = r.gauss(0, 1e9), r.gauss(0, 1.0)
        rows.append((i, [a, -a + b * 100, a + r.gauss(0, 1e3), b], 1))
    check_white(whiten(vecs(rows, "double"), components=4), rows, 4, tol=1e-4)


def test_whitening_leaves_directions_without_variance_null(vecs):
    rows = [(i, [v[0], v[0] + 1.0, 5.0, v[1]], lab) for i, v, lab in random_rows(50, 2, 2)]
    out = whiten(vecs(rows, "double")).collect()
    assert all(r["whitened"][:2] != [None, None] and r["whitened"][2:] == [None, None] for r in out)
    assert all(r["identity_error"] < 1e-9 and abs(sum(r["explained"]) - 1) < 1e-9 for r in out)
    same = whiten(vecs([(i, [1.0, 2.0], 1) for i in range(5)])).collect()
    assert all(r["whitened"] == [None, None] and r["explained"] == [None, None] and r["identity_error"] is None
               and r["deviation"] == 0 for r in same)
    one = whiten(vecs([(1, [1.0, 2.0], 1)])).collect()
    assert len(one) == 1 and one[0]["whitened"] == [None, None]


def test_whitening_of_repeated_rows_null_ids_and_nothing(vecs):
    rows = random_rows(20, 3, 7)
    out = whiten(vecs(rows + rows + [(None, [1.0, 2.0, 3.0], 1)], "double")).collect()
    assert len(out) == 41 and sum(r["id"] is None for r in out) == 1 and {r["n"] for r in out} == {41}
    empty = whiten(vecs([]))
    assert empty.count() == 0 and empty.columns[0] == "id" and whiten(vecs(BAD[:5])).count() == 0


def test_whitening_is_exact_where_longs_end(vecs):
    rows = [(i, [float(2 ** 50 + 3 * i), float(i)], 1) for i in range(10)]
    dev, _, _ = white_oracle(rows, 1)
    got = {r["id"]: r["deviation"] for r in whiten(vecs(rows, "double")).collect()}
    assert got == {i: int(d) if d < 2 ** 63 else None for (i, _, _), d in zip(rows, dev)}
    wild = [(0, [2.0 ** 55], 1), (1, [-(2.0 ** 55)], 1), (2, [0.0], 1)]
    assert {r["deviation"] for r in whiten(vecs(wild, "double")).collect()} == {None, 0}


def test_triangular_solve_and_shift():
    r = np.random.default_rng(3)
    z = r.normal(size=(50, 7)) @ np.diag(10.0 ** -np.arange(7))
    f = shifted_cholesky(z.T @ z, True)
    assert np.allclose(np.tril(f, -1), 0) and np.allclose(solve_rows(z, f) @ f, z)
    assert np.isfinite(shifted_cholesky(np.ones((5, 5)), False)).all()


# ---- codes -------------------------------------------------------------------------

def codes_oracle(rows, parts, entries, rounds):
    x = {k: [math.floor(1024 * a) for a in v] for k, (_, v, _) in enumerate(rows)}
    size = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * size:(p + 1) * size]
    first = sorted(x, key=lambda k: (rows[k][0], x[k]))[:entries]
    books = [[cut(x[k], p) for k in first] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    find = lambda: {k: [min((dist(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)]
                    for k, v in x.items()}
    for _ in range(rounds):
        at = find()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [cut(x[k], p) for k in x if at[k][p][1] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    at = find()
    text = ",".join(str(c) for b in books for e in b for c in e)
    return ([("".join(f"{j:02x}" for _, j in at[k]), sum(d for d, _ in at[k])) for k in range(len(rows))],
            hashlib.sha256(text.encode()).hexdigest())


@pytest.mark.parametrize("spread,dim,parts", [(1.0, 4, 4), (0.2, 12, 4), (3e8, 4, 2)])
def test_codes_match_brute_force(vecs, spread, dim, parts):
    rows = random_rows(220, dim, 5, spread)
    rows += [(1000 + i, rows[3][1], 7) for i in range(40)]  # copies of one vector
    rows += [(2000 + i, [float(i % 2)] * dim, 1) for i in range(20)]  # ties
    bad = [r for r in BAD if r[0] not in (905, 906)]
    out = {r["id"]: r for r in compress(vecs(rows + bad, "double"), parts=parts, entries=16, rounds=3).collect()}
    want, digest = codes_oracle(rows, parts, 16, 3)
    assert len(out) == len(rows)
    sums = {}
    for (i, _, lab), (_, err) in zip(rows, want):
        sums[lab] = sums.get(lab, 0) + err
    for (i, _, lab), (code, err) in zip(rows, want):
        got = out[i]
        assert got["code"] == code and got["codebooks_sha256"] == digest
        assert got["error"] == (err if err < 2 ** 63 else None)
        assert got["label_error"] == (sums[lab] if sums[lab] < 2 ** 63 else None)


def test_codes_of_few_repeated_and_no_rows(vecs):
    rows = [(1, [0.5, -0.5, 0.25, 1.0], None)] * 3 + [(2, [0.0, 0.0, 0.0, 0.0], 4)]
    out = compress(vecs(rows)).collect()
    assert len(out) == 4 and {r["error"] for r in out} == {0} and {r["code"] for r in out} == {"00000000", "03030303"}
    empty = compress(vecs([]))
    assert empty.count() == 0 and empty.columns == ["id", "label", "code", "error", "label_error", "codebooks_sha256"]
    odd = compress(vecs([(i, [float(i), 1.0, 2.0], 1) for i in range(9)]), parts=2, entries=2)
    assert odd.count() == 9  # parts of two and one entries


def test_rings_never_miss_a_nearer_entry():
    r = np.random.default_rng(8)
    for wide in (False, True):
        x = np.floor(r.normal(size=(400, 3)) * 20)
        book = np.floor(r.normal(size=(30, 3)) * 20)
        book[7] = book[3]  # equal entries: the lower index wins
        x, book = (x.astype(int).astype(object), book.astype(int).astype(object)) if wide else (x, book)
        now = nearest(x, book)
        moved = book + (r.integers(-3, 4, size=book.shape) if not wide else r.integers(-3, 4, size=book.shape).astype(object))
        moved[:5] = book[:5]
        far = np.array([max([math.sqrt(float(((x[i] - book[e]) ** 2).sum())) for i in np.flatnonzero(now == e)], default=-1.0)
                        for e in range(30)])
        assert (reassign(x, now, make_balls(book, moved, far)) == nearest(x, moved)).all()
        stood = make_balls(book, book, far)
        assert stood.still.all() and (reassign(x, now, stood) == now).all()
    assert book_digest([np.array([[1, -2]])]) == hashlib.sha256(b"1,-2").hexdigest()


# ---- shards ------------------------------------------------------------------------

def test_shards_are_equal_gapless_and_rerun_alike(docs, text):
    r = random.Random(11)
    copy = text(1, 30)
    data = [(i, text(i, r.randint(1, 60)), r.choice(["en", "de", None]), r.choice(["web", "news", None])) for i in range(400)]
    data += [(1000 + i, copy, "en", "hot") for i in range(250)] + [(2000, None), (2001, ""), (None, "no id", "en", "web")]
    data += [(2002, "twice", "en", "web")] * 3
    table = docs(data)
    got = assign_shards(table).collect()
    assert len(got) == len(data)
    by = {}
    for g in got:
        by.setdefault(g["shard"], []).append(g)
    size = {s: sum(g["size"] for g in v) for s, v in by.items()}
    assert set(by) == set(range(8)) and max(size.values()) - min(size.values()) <= 3 * max(g["size"] for g in got)
    for s, v in by.items():
        assert sorted(g["slot"] for g in v) == list(range(len(v))) and {g["shard_bytes"] for g in v} == {size[s]}
    known = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in data}
    assert all((g["size"], g["text_crc32"]) == known[g["id"]] for g in got)
    key = lambda rows: sorted((str(g["id"]), g["shard"], g["slot"]) for g in rows)
    assert key(got) == key(assign_shards(table.repartition(5)).collect())


def kd_oracle(rows, k, node, out):
    """rows: (size, places, crc, id)."""
    if k == 1 or not rows:
        for slot, r in enumerate(rows):
            out[r[3]] = (node, slot)
        return
    width = [max(r[1][j] for r in rows) - min(r[1][j] for r in rows) for j in range(3)]
    along = width.index(max(width))
    rows = sorted(rows, key=lambda r: (r[1][along], r[2], r[3]))
    total, low, seen = sum(r[0] for r in rows), k // 2, 0
    sides = ([], [])
    for r in rows:
        sides[(2 * seen + r[0]) * k >= 2 * total * low].append(r)
        seen += r[0]
    kd_oracle(sides[0], low, node, out)
    kd_oracle(sides[1], k - low, node + low, out)


@pytest.mark.parametrize("shards", [1, 5, 8])
def test_shards_match_a_recursive_tree(docs, text, shards):
    r = random.Random(3)
    data = [(i, text(i % 40, 1 + (i % 40) ** 2 // 4), r.choice(["en", "de", None]), r.choice(["a", "b", "c", None])) for i in range(150)]
    size = {i: len(t.encode()) + 1 for i, t, *_ in data}
    octave = lambda n: len(f"{n:b}") * 8 + int(f"{n:b}".ljust(4, "0")[1:4], 2)

    def places(value):
        return {value(d): sum(size[e[0]] for e in data if value(e) < value(d)) for d in data}

    dims = [lambda d: (d[3] is None, d[3] or ""), lambda d: (d[2] is None, d[2] or ""), lambda d: octave(size[d[0]])]
    tables = [places(v) for v in dims]
    rows = [(size[d[0]], [t[v(d)] for t, v in zip(tables, dims)], zlib.crc32(d[1].encode()), d[0]) for d in data]
    want = {}
    kd_oracle(rows, shards, 0, want)
    got = {g["id"]: (g["shard"], g["slot"]) for g in assign_shards(docs(data), shards=shards).collect()}
    if shards == 8:  # slots follow the order of the last cut
        assert got == want
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in want.items()}


def test_shards_by_target_bytes_written_and_empty(docs, text, tmp_path, spark):
    table = docs([(i, text(i, 50), "en", "web") for i in range(60)] + [(100, None), (101, "x" * 20_000), (101, "x" * 20_000)])
    placed = write_shards(table, str(tmp_path / "out"), shards=None, target_bytes=10_000)
    total = sum(r["size"] for r in placed.collect())
    back = spark.read.parquet(str(tmp_path / "out"))
    assert placed.agg(F.countDistinct("shard")).first()[0] <= math.ceil(total / 10_000)
    assert back.count() == 63 and back.agg(F.sum("size")).first()[0] == total
    assert back.filter("text is null").count() == 1
    empty = assign_shards(docs([]))
    assert empty.count() == 0 and "shard" in empty.columns
