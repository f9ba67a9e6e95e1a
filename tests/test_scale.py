"""Operators whose cost once grew faster than their rows: same results by the new forms, and what they no longer do."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.functions.kernels import np_kernel
from platewise.operators import features as C
from platewise.operators import similarity as S
from platewise.operators import stats as K


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- C9
@pytest.mark.parametrize("width, most", [(64, 20_000), (2, 20_000), (2, 0)])
def test_pooled_vectors_are_summed_whole(spark, monkeypatch, width, most):
    monkeypatch.setattr(C, "POOL_WIDTH", width)
    monkeypatch.setattr(C, "POOL_BROADCAST", most)
    docs = spark.createDataFrame([(1, "a b a x"), (1, "b"), (2, "x y"), (3, None), (4, "e n")], "id bigint, t string")
    vectors = spark.createDataFrame([("a", [1.0, 2.0, None]), ("b", [10.0, 20.0, 30.0, 40.0, 50.0]), ("e", []), ("n", None),
                                     ("b", [100.0])], "token string, vector array<double>")
    pooled, unknown = C.sum_pool_tokens(docs, "id", "t", vectors)
    assert "Exchange" not in _plan(pooled)  # coordinates are rows only after the last shuffle
    assert {(r["id"], r["dim"]): r["value"] for r in pooled.collect()} == {
        (1, 0): 222.0, (1, 1): 44.0, (1, 2): 60.0, (1, 3): 80.0, (1, 4): 100.0}
    assert {r["id"]: r["unknown_tokens"] for r in unknown.collect()} == {1: 1, 2: 2, 4: 1}


# ---------------------------------------------------------------- C3 / C4
def _bits(grams, n_bits):
    return sorted({int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % n_bits for g in grams})


def _grams(text, radius):
    return {text[i:i + n] for n in range(1, radius + 1) for i in range(len(text) - n + 1)}


def test_prints_of_a_text_are_made_in_its_own_row(spark, monkeypatch):
    monkeypatch.setattr(C, "STRETCH", 1)  # 64 characters a stretch
    rows = [(1, "ab\nc𝒳é" * 40), (2, ""), (3, None), (4, "xyz"), (4, "uv"), (4, "xyz")]
    df = spark.createDataFrame(rows, "candidate_id bigint, t string")
    fp = C.hashed_fingerprint(df, "t", 3, 256)
    plan = _plan(fp)
    assert "Generate" not in plan and "MapInPandas" in plan  # grams are never rows
    want = {1: _bits(_grams(rows[0][1], 3), 256), 2: [], 3: [], 4: _bits(_grams("xyz", 3) | _grams("uv", 3), 256)}
    got = [(r["candidate_id"], r["bits"]) for r in fp.collect()]
    assert len(got) == 6 and all(bits == want[i] for i, bits in got)


def test_difference_prints_are_made_in_one_row(spark):
    rows = [(1, "abcd", "abxd"), (2, None, "ab"), (3, "same", "same"), (4, "ab", "q"), (4, "q", None)]
    fp = C.difference_fingerprint(spark.createDataFrame(rows, "candidate_id bigint, a string, b string"), "a", "b", 3, 512)
    assert "Generate" not in _plan(fp)
    want = {1: _grams("abcd", 3) ^ _grams("abxd", 3), 2: _grams("ab", 3), 3: set(), 4: _grams("ab", 3)}
    got = [(r["candidate_id"], r["bits"]) for r in fp.collect()]
    assert len(got) == 5 and all(bits == _bits(want[i], 512) for i, bits in got)


# ---------------------------------------------------------------- C13
def test_dense_prints_are_laid_out_once(spark):
    df = spark.createDataFrame([([1, 3, 3, 9, -1],), ([],), (None,), ([0, None],)], "b array<int>")
    out = df.select(C.bits_to_dense("b", 5).alias("d"))
    assert "array_contains" not in _plan(out)  # no search per position
    assert [r["d"] for r in out.collect()] == [[0, 1, 0, 1, 0], [0] * 5, [0] * 5, [1, 0, 0, 0, 0]]


def test_featurize_makes_every_vector_once(spark, tmp_path):
    from platewise.plans.features_q import q_featurize

    rows = [(1, "ab 12, http://x.y", "en"), (2, None, "en"), (3, "", "en"), (4, "é7 Z\n", "fr")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    out = q_featurize(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("dense(") == 1 and plan.count("count(cast(") == 1  # not once more for the planner's checks of sizes
    got = {i: {r["dim"]: r["value"] for r in out.collect() if r["candidate_id"] == i} for i in range(1, 5)}
    for i, text, _ in rows:
        want = {b: 1.0 for b in _bits(_grams(text or "", 2), 1024)}
        want |= {1024 + k: n for k, p in enumerate(C.PATTERN_CATALOGUE.values()) if (n := len(re.findall(p, text or "")))}
        assert got[i] == want


def test_patterns_of_plain_classes_are_counted_in_bytes(spark):
    texts = ["a1 b22 (x[3])=# Http://a https://b\n\n é𝒳9z AB.c,;!@ ", "", None, "9", "aaab", "é" * 5, "xx1x1 1x"]
    odd = {"dot": ".", "two": "aa", "any": "[^a]", "either": "a|b", "same": "[a-c][b-d]", "some": "[é]+", "range": "[+-9]"}
    catalogue = C.PATTERN_CATALOGUE | odd
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    out = C.pattern_counts(df, "t", catalogue)
    assert "\\[a-z\\]" not in _plan(out) and "[a-z]" not in _plan(out)  # no regex scan for it
    for r in out.collect():
        t = texts[r["id"]]
        assert r["counts"] == [None if t is None else len(re.findall(p, t)) for p in catalogue.values()]


# ---------------------------------------------------------------- E5
def test_average_similarity_sends_a_row_a_bounded_number_of_times(spark, monkeypatch):
    seen = []
    pack = S.pack_blocks
    monkeypatch.setattr(S, "TILE_ROWS", 4)
    monkeypatch.setattr(S, "TILE_BLOCKS", 3)
    monkeypatch.setattr(S, "pack_blocks", lambda *a: seen.append(pack(*a)) or seen[-1])
    x = np.random.default_rng(5).normal(size=(40, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, x array<double>")
    got = S.average_similarity(df, "id", "x", "matern25").first()[0]
    assert seen[0][0].count() == 3  # ten blocks of the least size before
    k = np_kernel("matern25", x, x)
    off = ~np.eye(40, dtype=bool)
    lo, hi = (np.array([f(k[off[:, j], j]) for j in range(40)]) for f in (np.min, np.max))
    assert abs(got - ((k - lo) / (hi - lo))[off].mean()) < 1e-9


# ---------------------------------------------------------------- K3 / K4
def test_value_counts_of_pairs_get_more_tasks_with_the_rows(spark, monkeypatch):
    asked = []
    cumsum = K.global_cumsum
    monkeypatch.setattr(K, "PART_ROWS", 10)
    monkeypatch.setattr(K, "global_cumsum", lambda *a, **kw: asked.append(kw.get("n_parts")) or cumsum(*a, **kw))
    df = spark.createDataFrame([(i, "abc"[i % 3], float(i * 7 % 11)) for i in range(90)], "id bigint, p string, m double")
    many = sorted(map(str, K.pairwise_levels(df, "p", "m", "id").collect()))
    monkeypatch.setattr(K, "PART_ROWS", 10_000)
    assert many == sorted(map(str, K.pairwise_levels(df, "p", "m", "id").collect())) and len(many) == 3
    assert asked == [18, int(spark.conf.get("spark.sql.shuffle.partitions"))]
