"""Exact, line and near dedup, and vector links, each against a plain brute force."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from platewise.llm.block_names import exact_groups
from platewise.llm.common import components
from platewise.llm.ego_join import join_blocks, link_vectors
from platewise.llm.line_dedup import dedup_lines
from platewise.llm.setsketch import jaccard_estimate, near_groups, registers, shingle_hashes

BLANK = " \t\n\x0b\x0c\r"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def closure(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# ---- exact -------------------------------------------------------------------------

def test_exact_groups_match_brute_force(docs, text):
    r = random.Random(1)
    long = text(5, 4000)
    data = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "ab"), (6, "a  b\t"), (7, "a b"), (8, long),
            (9, long.replace(" ", "\n")), (10, long + "x"), (11, "x" + long), (None, "ab"), (4, "a b")]
    data += [(100 + i, r.choice(["rep one", "rep  one", "rep\none"])) for i in range(60)]
    out = exact_groups(docs(data), block_bytes=64)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = {}
    for i, t in data:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0))
    want = []
    for i, t in data:
        best = min(groups[norm(t)])
        want.append((i, None if best[1] else best[2], len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()))
    got = out.collect()
    assert sorted(((r["id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["id"] == r["keep_id"] for r in kept)


def test_exact_groups_of_an_empty_table(docs):
    assert exact_groups(docs([(1, "a")]).limit(0)).count() == 0


# ---- lines -------------------------------------------------------------------------

def brute_lines(data, min_chars=10, min_docs=2):
    key = lambda x: x.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in data:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                held.setdefault(key(x), set()).add(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in first or first[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept) if len(kept) < len(lines) else t))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(docs):
    common = "A line that many share"
    data = [(1, None), (2, ""), (3, "\n\n"), (4, f"{common}\nown line of four\n{common.lower()}"), (5, f" \t{common.upper()}\r"),
            (6, f"{common}\nkept\n{common} "), (7, "short\nshort"), (8, "short"), (9, "ÄÖÜ same line\nx"), (10, "äöü same line"),
            (11, "ÄÖÜ SAME LINE"), (None, f"{common}\nonly without id"), (None, "only without id"), (12, "only without id"),
            (5, f" \t{common.upper()}\r"), (13, "same id rows\nvaried"), (13, "same id rows")]
    data += [(100 + i, f"hot line for all\nunique line {i:05d}") for i in range(80)]
    data += [(300, "\n".join(f"line number {k:06d}" for k in range(5000))), (301, "line number 004999")]
    out = dedup_lines(docs(data))
    assert rows(out, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(data)
    assert "kept" in out.columns and "rid" in out.columns
    assert dedup_lines(docs(data).limit(0)).count() == 0


def test_line_dedup_at_a_higher_threshold(docs):
    data = [(i, f"shared by {'three' if i < 3 else 'two'} documents") for i in range(5)]
    assert rows(dedup_lines(docs(data), min_docs=3), "doc_id", "n_lines", "n_dropped", "text") == brute_lines(data, min_docs=3)


# ---- near --------------------------------------------------------------------------

def brute_near(data):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(data)), 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = closure(range(len(data)), links)
    out = []
    for k, (i, _) in enumerate(data):
        ids = [data[j][0] for j in root if root[j] == root[k] and data[j][0] is not None]
        out.append((i, len(sets[k]), min(ids, default=None)))
    return sorted(out, key=repr)


def edited(base, r, edits):
    w = base.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_near_groups_match_brute_force(docs, text):
    r = random.Random(3)
    data = [(1, None), (2, ""), (3, " \t\n"), (4, "two words"), (5, "TWO\nwords"), (6, "two words more"), (7, "a b c d e"),
            (8, "a b c d e"), (9, "a b c d E f"), (None, "two words"), (None, "nothing like it"), (4, "two words")]
    for g in range(12):
        base = text(g, r.choice([40, 200, 900]))
        data += [(1000 * (g + 1) + k, edited(base, r, r.randrange(0, 9))) for k in range(8)]
    chain = text(99, 300).split()  # neighbours link, ends do not
    for k in range(10):
        data.append((50_000 + k, " ".join(chain)))
        for j in range(6):
            chain[30 * k + 5 * j] = f"c{k}{j}"
    data.append((60_000, text(98, 30_000)))
    data.append((60_001, text(98, 30_000) + " end"))
    out = near_groups(docs(data))
    assert rows(out, "id", "n_shingles", "component_id") == brute_near(data)
    got = out.collect()
    assert all(x["kept"] == (x["id"] == x["component_id"]) for x in got if x["id"] is not None)
    assert near_groups(docs(data).limit(0)).count() == 0


def test_one_large_near_copy_group_and_blocks(docs, text, monkeypatch):
    """Leftover buckets are compared in blocks; with tiny blocks the result is the same."""
    import platewise.llm.setsketch as S

    monkeypatch.setattr(S, "BLOCK", 4)
    r = random.Random(8)
    base = text(7, 60)
    data = [(i, edited(base, r, r.randrange(0, 5))) for i in range(150)]
    assert rows(near_groups(docs(data)), "id", "n_shingles", "component_id") == brute_near(data)


def test_registers_estimate_the_similarity():
    r = np.random.default_rng(0)
    for j in (0.3, 0.75, 0.9):
        n = 3000
        both = r.integers(0, 2**63, int(n * 2 * j / (1 + j))).astype(np.uint64)
        rest = n - len(both)
        a, b = (np.unique(np.append(both, r.integers(0, 2**63, rest).astype(np.uint64))) for _ in range(2))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = registers([a, b], 1024)
        got = jaccard_estimate(np.array([len(a)]), np.array([len(b)]), np.array([(x > y).sum()]), np.array([(x < y).sum()]), 1024)
        assert abs(got[0] - true) < 0.06
    # mergeable: the registers of a union are the larger ones
    u = registers([np.union1d(a, b)], 1024)[0]
    assert (u == np.maximum(x, y)).all()


def test_shingle_hashes_do_not_depend_on_company(text):
    texts = [text(i, n) for i, n in enumerate([0, 1, 4, 5, 6, 50, 3000])]
    alone = [shingle_hashes([t], 5)[0] for t in texts]
    assert all((a == b).all() for a, b in zip(alone, shingle_hashes(texts, 5)))
    assert shingle_hashes([texts[5].upper().replace(" ", "\r\n")], 5)[0].tolist() == alone[5].tolist()


# ---- vectors -----------------------------------------------------------------------

def brute_vectors(data, cosine):
    unit = []
    for _, v in data:
        x = np.array([math.nan if c is None else c for c in v], float) if v else np.zeros(0)
        ok = len(x) == 6 and np.isfinite(x).all() and (x != 0).any()
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = [(a, b) for a, b in itertools.combinations(range(len(data)), 2)
             if unit[a] is not None and unit[b] is not None and float(unit[a] @ unit[b]) >= cosine]
    root = closure(range(len(data)), links)
    deg = {k: 0 for k in range(len(data))}
    for a, b in links:
        deg[a] += 1
        deg[b] += 1
    out = []
    for k, (i, _) in enumerate(data):
        ids = [data[j][0] for j in root if root[j] == root[k] and data[j][0] is not None]
        out.append((i, deg[k], min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_match_brute_force(spark, kind):
    r = np.random.default_rng(2)
    data = [(1, None), (2, []), (3, [0.0] * 6), (4, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (5, [math.nan] + [1.0] * 5),
            (6, [math.inf] + [1.0] * 5), (7, [1.0, 2.0, 3.0]), (None, [1.0] * 6), (8, [2.0] * 6), (8, [2.0] * 6)]
    centre = r.normal(size=(5, 6))
    for k in range(300):
        v = r.normal(size=6) if k % 3 else centre[k % 5] + r.normal(size=6) * 0.03
        data.append((100 + k, [float(np.float32(x)) for x in v]))
    data += [(1000 + k, [5.0, 4.0, 3.0, 2.0, 1.0, 0.5]) for k in range(90)]
    df = spark.createDataFrame([(i, v, "x") for i, v in data], f"vec_id bigint, embedding array<{kind}>, root string").repartition(3)
    out = link_vectors(df, cosine=0.95, block_rows=16, cell_dims=3)
    assert rows(out, "id", "n_links", "component_id") == brute_vectors(data, 0.95)
    assert all(x["kept"] == (x["id"] == x["component_id"]) for x in out.collect() if x["id"] is not None)
    assert link_vectors(df.limit(0)).count() == 0


def test_block_pairs_count_every_link_once():
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 4))
    x /= np.linalg.norm(x, axis=1)[:, None]
    na, nb, label = join_blocks(x, x, True, 0.9, np.eye(4))
    hit = x @ x.T >= 0.9
    assert (na == hit.sum(1) - 1).all() and not nb.any() and len(label) == 600


# ---- components --------------------------------------------------------------------

def test_components_of_paths_stars_and_cliques(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 150)]
    edges += list(itertools.combinations(range(5000, 5012), 2)) + [(7, 7), (9000, 9001), (9001, 9000)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = closure({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    by = {}
    for n, root in got.items():
        by.setdefault(root, set()).add(n)
    ref = {}
    for n, root in want.items():
        ref.setdefault(root, set()).add(n)
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, ref.values()))
    assert all(root in by[root] for root in by)


def test_a_hot_vector_gives_only_its_share_of_the_sample(spark):
    """Thousands of copies of one vector, under ids of their own or none, beside a few others."""
    r = np.random.default_rng(3)
    hot, rest = r.normal(size=6), r.normal(size=(40, 6))
    rows = [(i, hot.tolist()) for i in range(3000)] + [(5000 + i, v.tolist()) for i, v in enumerate(rest)]
    out = link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample_rows=64, block_rows=256)
    got = {x["id"]: x for x in out.collect()}
    assert len(got) == 3040
    unit = np.vstack([hot, rest]) / np.linalg.norm(np.vstack([hot, rest]), axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    for i in range(3000):
        assert got[i]["component_id"] == 0 and got[i]["n_links"] == 2999 + near[0, 1:].sum()
    for k in range(40):
        assert got[5000 + k]["n_links"] == 3000 * near[k + 1, 0] + near[k + 1, 1:].sum() - 1
    nameless = spark.createDataFrame([(None, hot.tolist())] * 500, "vec_id long, embedding array<double>")
    alike = link_vectors(nameless, sample_rows=8, block_rows=64).collect()
    assert len(alike) == 500 and {x["n_links"] for x in alike} == {499} and sum(x["kept"] for x in alike) == 1
