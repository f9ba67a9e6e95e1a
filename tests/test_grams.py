"""Character grams counted block by block: the packed form against counts made by hand."""

import re
from collections import Counter

import pytest

from platewise.operators import features as C
from platewise.operators import grams as P

TEXTS = [(1, "ab  \n ab"), (2, "x" * 200), (2, "xy"), (None, "\U0001F600b\x00"), (None, "b"), (3, None), (4, ""),
         (5, "abc " * 50), (6, "\x00a\x00"), (7, "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))), (8, "é"), (9, "\x00a\x00")]


def wanted(texts, longest):
    """(id, n_distinct, n_grams, index_checksum, max_index) of every id with grams."""
    counts = {}
    for i, t in texts:
        t = re.sub(r"\s\s+", " ", t or "")
        counts.setdefault(i, Counter()).update(t[k:k + n] for n in range(1, longest + 1) for k in range(len(t) - n + 1))
    index = {g: k for k, g in enumerate(sorted(set().union(*counts.values())))}
    return {i: (len(c), sum(c.values()), sum(index[g] * n for g, n in c.items()), max(index[g] for g in c)) for i, c in counts.items() if c}


def digest(df, longest):
    counts = C.char_ngrams(df, "id", "t", longest, packed=True).persist()
    return counts, C.gram_digest(df, counts, C.gram_vocabulary(counts), "id", "t", longest)


@pytest.mark.parametrize("longest", [1, 3, 5, 7])
def test_packed_counts_give_the_digests_of_the_texts(spark, monkeypatch, longest):
    monkeypatch.setattr(C, "STRETCH", 1)
    df = spark.createDataFrame(TEXTS, "id long, t string").repartition(3)
    _, got = digest(df, longest)
    rows = [tuple(r) for r in got.select("id", *P.DIGEST).collect()]
    assert len(rows) == len(wanted(TEXTS, longest)) and {r[0]: r[1:] for r in rows} == wanted(TEXTS, longest)


def test_small_blocks_and_chunks_give_the_same(spark, monkeypatch):
    for name, most in (("CHUNK", 50), ("BLOCK_GRAMS", 300), ("PENDING", 100), ("GRAM_ROWS", 64), ("BATCH_ROWS", 3)):
        monkeypatch.setattr(P, name, most)
    texts = [(i, f"text {i * 7919 % 1000} of {i % 13} words é\U0001F600" * (1 + i % 5)) for i in range(120)]
    counts, got = digest(spark.createDataFrame(texts, "id long, t string").repartition(2), 5)
    assert counts.selectExpr("shiftright(at, 1) b").distinct().count() > 4
    assert {r["id"]: tuple(r[c] for c in P.DIGEST) for r in got.collect()} == wanted(texts, 5)


def test_a_block_lists_a_gram_once_however_many_texts_have_it(spark):
    texts = [(i, "the same words in every text " * 20) for i in range(300)]
    counts, got = digest(spark.createDataFrame(texts, "id long, t string").coalesce(1), 5)
    assert counts.filter("gram is not null").count() == wanted(texts, 5)[0][0]  # 300 times that in long form
    assert got.count() == 300


def test_no_texts_give_no_digest(spark):
    _, got = digest(spark.createDataFrame([(1, None), (2, "")], "id long, t string"), 5)
    assert got.count() == 0
