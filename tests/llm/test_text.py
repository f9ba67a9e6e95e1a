"""Language ID, mixing, packing, suffix tree, licences and page text on small fixtures."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from platewise.llm import suffix_lm as S
from platewise.llm.common import crc_mod
from platewise.llm.html_main import extract_pages, main_text
from platewise.llm.hyper_lang import gram_counts, gram_vectors, identify, learn_prototypes
from platewise.llm.licences import TEMPLATES, scan_licences, size_bounds, template_bigrams
from platewise.llm.mixing import mix_sources
from platewise.llm.packing import Bpe, pack, tail_cuts
from platewise.llm.suffix_lm import score_documents

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


# ---- language ----------------------------------------------------------------------

VOICES = {"aa": "kala mata sano vene lumi tora", "bb": "strix prond glaff krent blisk", "cc": "żółw ćma łąka źdźbło ńiwa"}


def voice(lang, seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(VOICES[lang].split()) for _ in range(n))


def test_languages_are_told_apart(docs):
    train = [(i, voice(lang, i, 60), lang) for i, lang in enumerate(list(VOICES) * 10)]
    train += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", "cc"), (903, voice("aa", 1, 9), None)]
    protos = learn_prototypes(docs(train))
    assert sorted(protos) == ["aa", "bb", "cc"]
    test = [(i, voice(lang, 500 + i, 12), lang) for i, lang in enumerate(list(VOICES) * 5)]
    test += [(50, None), (51, ""), (52, " 12 \n%"), (53, "a"), (54, voice("bb", 3, 250_000)), (55, voice("aa", 3, 12)),
             (55, voice("aa", 3, 12)), (None, voice("cc", 3, 12))]
    out = identify(docs(test), protos)
    got = out.collect()
    assert len(got) == len(test) and set(docs(test).columns) < set(out.columns)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in [t for t in test if len(t) == 3])
    assert [by[i]["lang_pred"] for i in (50, 51, 52)] == ["und"] * 3 and by[54]["lang_pred"] == "bb"
    assert all(0.0 <= r["score"] <= 1.0 for r in got) and by[55]["lang_pred"] == "aa" and by[53]["lang_pred"] in VOICES
    assert identify(docs(test).limit(0), protos).count() == 0
    assert {r["lang_pred"] for r in identify(docs(test), learn_prototypes(docs(train).limit(0))).collect()} == {"und"}


def test_prototypes_are_the_bundles_of_bound_vectors(docs):
    protos = learn_prototypes(docs([(1, "abab", "x"), (2, "zz", "x")]))
    codes = Counter()
    for t in ("abab", "zz"):
        s = [0, *[ord(c) - 96 for c in t], 0]
        codes.update(a * 4096 + b * 64 + c for a, b, c in zip(s, s[1:], s[2:]))
    want = sum(n * gram_vectors(np.array([c])).astype(int)[0] for c, n in codes.items())
    assert (protos["x"] == want).all()


def test_long_text_is_counted_whole():
    t = "abc " * 1_500_000
    (_, _, codes, counts), = gram_counts([t])
    assert counts.sum() == 4 * 1_500_000 - 1 and len(codes) == 4


def test_held_out_languages_on_the_supplied_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = crc_mod(F.col("doc_id"), 4) == 2
    out = identify(docs.filter(held), learn_prototypes(docs.filter(~held)))
    assert out.filter("lang = lang_pred").count() >= 0.95 * out.count()


# ---- mixing ------------------------------------------------------------------------

def test_mix_meets_targets_and_agrees(docs):
    r = random.Random(1)
    data = [(i, " ".join(["w"] * min(3000, int(r.paretovariate(1.1) * 5))), "en", r.choice(["a", "a", "a", "b", "c", None]))
            for i in range(900)]
    data += [(2000, None, "en", "a"), (2001, "", "en", "b"), (2002, None, "en", "empty"), (None, "w w w", "en", "a"),
             (5, "w w w", "en", "a"), (5, "w w w", "en", "a")]
    out = mix_sources(docs(data).withColumnRenamed("kept", "target"))
    got = out.collect()
    assert len(got) == len(data)
    sizes, taken, targets = Counter(), Counter(), {}
    key = {}
    for i, t, _, s in data:
        sizes[s] += len((t or "").split())
        key.setdefault((i, t), s)
    per_source = {}
    for x in got:
        per_source.setdefault(x["source_size"], [0, x["target"], 0])
        per_source[x["source_size"]][0] += x["taken"]
        per_source[x["source_size"]][2] = max(per_source[x["source_size"]][2], x["size"])
        assert 0 <= x["taken"] <= 2 * x["size"] and x["taken"] == x["copies"] * x["size"]
    for size, (took, target, largest) in per_source.items():
        assert target <= 2 * size + 1e-9 and abs(took - target) <= 2 * largest + 0.02 * target
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: [3.0, 1.0, 2.0][k % 3] for k, s in enumerate(order)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (goal - sum(2 * sizes[s] for s in full)) / sum(w[s] for s in w if s not in full)
        more = {s for s in w if s not in full and 2 * sizes[s] <= level * w[s]}
        if not more:
            break
        full |= more
    want = {sizes[s]: 2.0 * sizes[s] if s in full else level * w[s] for s in w}
    assert all(abs(per_source[k][1] - v) < 1e-6 * max(1, v) for k, v in want.items())
    again = mix_sources(docs(data).repartition(7).withColumnRenamed("kept", "target"))
    pick = lambda df: sorted((tuple(r) for r in df.select("id", "size", "target", "taken").collect()), key=repr)
    assert pick(out) == pick(again)
    assert mix_sources(docs(data).limit(0)).count() == 0


# ---- packing -----------------------------------------------------------------------

def test_ids_equal_the_tokenizers_file(text):
    from tokenizers import Tokenizer

    bpe, full = Bpe(JSON, RANKS), Tokenizer.from_file(JSON)
    r = random.Random(4)
    odd = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a \n \nb", "\n\n a", "x  y", "x  y", "<|endoftext|>",
           "a <|endoftext|> b", "it's they'll 'S", "ÄÖ ñ 你好 🙂🙂 x", "\x1c \x1c a", "tab\t tab\t\tq", "a\r\n b", "1234 567.89 $%& ..."]
    odd += ["".join(r.choice(" \n\t ab1.'é") for _ in range(r.randrange(1, 40))) for _ in range(800)]
    odd += [text(i, 300) for i in range(3)]
    for t in odd:
        assert np.frombuffer(bpe.encode(t), bpe.dtype).tolist() == full.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing_is_a_round_trip(docs, text):
    data = [(i, text(i, 30 + 17 * (i % 50)), "en", f"s{i % 3}") for i in range(120)]
    data += [(500, None, "en", None), (501, "", "en", "s0"), (None, "no id", "en", "s1"), (2**60 + 1, "a large id", "en", "s1"), (502, text(9, 20_000), "en", "s2"),
             (7, text(7, 40), "en", "s1"), (7, text(7, 40), "en", "s1")]
    got = pack(docs(data), JSON, RANKS, window=8192).collect()
    bpe = Bpe(JSON, RANKS)
    want = Counter(((i, np.frombuffer(bpe.encode(t or ""), bpe.dtype).astype("<u4").tobytes() + b"\x01\0\0\0") for i, t, _, _ in data))
    # sequences are gapless and full, or a power of two
    seqs = {}
    for p in got:
        assert len(p["ids"]) == 4 * p["length"] and 0 < p["length"] <= 2048
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    total = 0
    for v in seqs.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:]))
        size = v[-1][0] + v[-1][1]
        total += size
        assert size == 2048 or size & (size - 1) == 0
    assert sorted(seqs) == list(range(len(seqs))) and total == sum(len(k[1]) // 4 * n for k, n in want.items())
    # documents come back from their pieces (equal rows are interchangeable)
    parts = {}
    for p in got:
        parts.setdefault((p["id"], p["doc_tokens"]), Counter())[(p["start"], p["ids"])] += 1
    for (i, ids), n in want.items():
        mine = parts[(i, len(ids) // 4)]
        assert all(ids[4 * s:4 * s + len(b)] == b for s, b in mine)
        assert sum(len(b) * c for (_, b), c in mine.items()) == n * len(ids)
    assert pack(docs(data).limit(0), JSON, RANKS).count() == 0


def test_windows_keep_the_proportions(docs, text):
    data = [(i, text(i, 40), "en", "big" if i % 4 else "small") for i in range(600)]
    got = pack(docs(data), JSON, RANKS, window=16384).collect()
    share = sum(p["length"] for p in got if p["source"] == "small") / sum(p["length"] for p in got)
    windows = {}
    for p in got:
        windows.setdefault(p["window"], Counter())[p["source"]] += p["length"]
    longest = max(p["doc_tokens"] for p in got)
    carried = 0.0
    for w in sorted(windows)[:-1]:  # the deficit carried on never reaches a document
        carried += share * 16384 - windows[w]["small"]
        assert -1e-6 <= carried < longest
    even = pack(docs(data), JSON, RANKS, window=16384, weights={"big": 1.0, "small": 1.0}).collect()
    first = Counter()
    for p in even:
        if p["window"] == 0:
            first[p["source"]] += p["length"]
    assert abs(first["big"] - first["small"]) <= 2 * longest


def test_the_tail_is_cut_into_powers_of_two():
    assert tail_cuts(4096, 2048) == [] and tail_cuts(0, 2048) == []
    assert tail_cuts(4096 + 1024 + 5, 2048) == [5120, 5124, 5125]


# ---- suffix tree -------------------------------------------------------------------

def test_scores_match_brute_force(docs, text, monkeypatch):
    monkeypatch.setattr(S, "HOT", 0.01)  # most words take the join
    data = [(i, text(i, 25 + i % 40)) for i in range(80)]
    data += [(200, None), (201, ""), (202, "Never SEEN wordé"), (None, "w1 w2"), (3, text(3, 28)), (203, "q" * 70_000)]
    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    out = score_documents(docs(data), F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 1))
    toks = [(i, [*S.tokens(t), b"\n"]) for i, t in data]
    c = Counter(w for i, t in toks if learn(i) for w in t)
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in toks:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want.append((repr(i), learn(i), len(t), sum(c[w] > 0 for w in t), n, round(base, 6)))
    got = out.collect()
    assert sorted((repr(r["id"]), r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                  for r in got) == sorted(want)
    assert all(r["score"] < 0 for r in got)
    assert score_documents(docs(data).limit(0), F.lit(True)).count() == 0
    assert score_documents(docs(data), F.lit(False)).filter("n_known > 0").count() == 0


def test_the_tree_is_a_distribution_and_uses_longest_suffixes(spark):
    body = [S.tokens("abra kadabra abra zon " * 40), S.tokens("über abra")]
    counts = Counter()
    for _, _, buf, at in S._streams(body):
        for k, n in S._grams(buf, at):
            counts.update(dict(zip(k.tolist(), n.tolist())))
    tree = S.grow_tree(spark.createDataFrame(list(counts.items()), "gram bigint, n bigint"), gain=1e-3)
    prob = 10.0 ** tree.logp.reshape(-1, tree.width).astype(float)
    missing = 256 - (tree.width - 1)  # bytes never met share class 0, each with its probability
    assert np.allclose(prob[:, 1:].sum(1) + missing * prob[:, 0], 1.0, atol=1e-5)
    # the state of every position is the longest kept context, found here by string search
    names = {0: b""}
    inverse = {c: b for b, c in enumerate(tree.classes) if c}
    for s in range(len(prob)):
        for k in np.flatnonzero(tree.child[s * tree.width:(s + 1) * tree.width]):
            names[int(tree.child[s * tree.width + k])] = bytes([inverse[int(k)]]) + names[s]
    stream = b"\n" * S.DEPTH + b"abra zon kad\n"
    want = 0.0
    for p in range(S.DEPTH, len(stream)):
        best = max((s for s, c in names.items() if stream[:p].endswith(c)), key=lambda s: len(names[s]))
        want += math.log10(prob[best, tree.classes[stream[p]]])
    got = tree.score(np.frombuffer(stream, np.uint8), np.array([S.DEPTH]))
    assert abs(got[0] - want) < 1e-4


def test_the_tree_beats_the_words_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = score_documents(docs, crc_mod(F.col("doc_id"), 5) != 1).filter("not trained")
    r = out.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > r["b"]


def test_the_tree_grows_with_the_corpus(spark):
    r = random.Random(5)
    body = [S.tokens(" ".join(r.choice(["abra", "kadabra", "zon", "bar"]) for _ in range(300)))]
    counts = Counter()
    for _, _, buf, at in S._streams(body):
        for k, n in S._grams(buf, at):
            counts.update(dict(zip(k.tolist(), n.tolist())))
    trees = [S.grow_tree(spark.createDataFrame([(k, n * m) for k, n in counts.items()], "gram bigint, n bigint"))
             for m in (1, 100)]
    few, many = (len(t.logp) // t.width for t in trees)
    assert many > few > 1  # the same text a hundred times over is a hundred times the evidence


def test_a_few_symbols_can_save_more_than_8_bits_each(spark):
    counts = [(ord("x") << 8 | ord("y"), 7), (ord("a") << 8 | ord("x"), 7), (ord("a") << 8 | ord("a"), 7 * 2046)]  # x saves 7 * 11 bits
    tree = S.grow_tree(spark.createDataFrame(counts, "gram bigint, n bigint"), gain=64.0)
    assert tree.child[tree.classes[ord("x")]] > 0


def _slow_tree(streams, gain):
    """Counts, kept contexts and the probability of a symbol, by dictionaries of byte strings."""
    n = {}
    for body in streams:
        full = b"\n" * S.DEPTH + body
        for p in range(S.DEPTH, len(full)):
            for d in range(S.DEPTH + 1):
                n.setdefault(full[p - d:p], Counter())[full[p]] += 1
    kept = {b""}
    for c, after in n.items():
        up, both = n[c[1:]], (sum(after.values()), sum(n[c[1:]].values()))
        if c and sum(k * (math.log2(k / both[0]) - math.log2(up[s] / both[1])) for s, k in after.items()) >= gain:
            kept |= {c[i:] for i in range(len(c))}

    def prob(c, s):
        total, pull = sum(n[c].values()), S.PULL * len(n[c])
        return (n[c][s] + pull * (prob(c[1:], s) if c else 1 / 256)) / (total + pull)

    def score(body):
        full, out = b"\n" * S.DEPTH + body, 0.0
        for p in range(S.DEPTH, len(full)):
            out += math.log10(prob(next(full[p - d:p] for d in range(S.DEPTH, -1, -1) if full[p - d:p] in kept), full[p]))
        return out

    return kept, score


@pytest.mark.parametrize("gain,cells,parts", [(4.0, S.CELLS, 8), (4.0, 4000, 8), (12.0, 300, 3), (4.0, 0, 1)])
def test_kept_contexts_and_scores_match_brute_force(docs, text, monkeypatch, gain, cells, parts):
    monkeypatch.setattr(S, "PARTS", parts)
    monkeypatch.setattr(S, "PART", 1)
    data = [(i, text(i, 20 + i % 30)) for i in range(40)] + [(200, None), (201, ""), (202, "Größe 中文 über"), (3, text(3, 28))]
    data += [(203, "q" * 5000), (204, text(4, 20))]
    body = {t: b" ".join(S.tokens(t)) + b"\n" for _, t in data}
    learn = [body[t] for i, t in data if zlib.crc32(str(i).encode()) % 5 != 1]
    kept, slow = _slow_tree(learn, gain)
    got = score_documents(docs(data), crc_mod(F.col("doc_id"), 5) != 1, gain=gain, cells=cells).collect()
    want = sorted((i, slow(body[t])) for i, t in data)
    got = sorted((r["id"], r["score"]) for r in got)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert np.allclose([x for _, x in got], [x for _, x in want], rtol=1e-6, atol=1e-3)
    if cells == S.CELLS:
        counts = Counter()
        for _, _, buf, at in S._streams([S.tokens(t) for i, t in data if zlib.crc32(str(i).encode()) % 5 != 1]):
            for k, n in S._grams(buf, at):
                counts.update(dict(zip(k.tolist(), n.tolist())))
        tree = S.grow_tree(docs(data).sparkSession.createDataFrame(list(counts.items()), "gram bigint, n bigint"), gain=gain)
        assert len(tree.logp) // tree.width == len(kept) and tree.rest is None


def test_one_context_may_hold_nearly_all_counts(docs):
    data = [(i, "a" * 6000) for i in range(20)] + [(20 + i, "b ab ba " * 30) for i in range(20)]
    _, slow = _slow_tree([t.strip().encode() + b"\n" for _, t in data], 4.0)
    got = {r["id"]: r["score"] for r in score_documents(docs(data), F.lit(True), gain=4.0, cells=0).collect()}
    want = {t: slow(t.strip().encode() + b"\n") for t in {t for _, t in data}}
    assert len(got) == 40 and all(math.isclose(got[i], want[t], rel_tol=1e-6, abs_tol=1e-3) for i, t in data)


def test_states_outside_the_code_score_alike(docs, text):
    data = [(i, text(i, 25 + i % 40)) for i in range(60)] + [(200, None), (201, "Never SEEN wordé"), (None, "w1 w2"), (3, text(3, 28))]
    pick = lambda df: sorted((repr(r["id"]), r["n_tokens"], round(r["score"], 3)) for r in df.collect())
    learn = F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 5) != 1)
    whole = pick(score_documents(docs(data), learn, gain=8.0))
    for cells in (40, 1500):
        assert pick(score_documents(docs(data), learn, gain=8.0, cells=cells)) == whole


# ---- licences ----------------------------------------------------------------------

def test_licences_match_brute_force(docs, text):
    data = [(1, None), (2, ""), (3, TEMPLATES["MIT-text"]), (4, TEMPLATES["MIT-text"].replace(". ", ".\n")), (5, "one"),
            (6, "intro\nreleased UNDER the mit license\nReleased under the MIT License."), (7, text(1, 30_000)),
            (8, "This work is licensed under the GNU General Public License, version 3 or later."), (None, TEMPLATES["CC0-1.0"]),
            (9, "\n".join(TEMPLATES.values())), (6, "intro"), (6, "intro")]
    want = []
    for i, t in data:
        lines = (t or "").split("\n")
        hits, units, pairs = [], set(), 0
        for no, u in [(-1, t or ""), *enumerate(lines)]:
            b = set(template_bigrams(u))
            for name, body in TEMPLATES.items():
                g = set(template_bigrams(body))
                d = 2 * len(b & g) / (len(b) + len(g))
                lo, hi = size_bounds(len(g), 0.8)
                pairs += lo <= len(b) <= hi
                if d >= 0.8:
                    assert lo <= len(b) <= hi
                    hits.append((-d, no, name))
                    units.add(no)
        best = min(hits, default=None)
        want.append((i, len(lines), pairs, best and best[2], best and round(-best[0], 9), best and best[1], len(units)))
    got = [(r["id"], r["n_lines"], r["n_candidates"], r["licence"], r["dice"] and round(r["dice"], 9), r["line_no"], r["n_hits"])
           for r in scan_licences(docs(data)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert scan_licences(docs(data).limit(0)).count() == 0


# ---- pages -------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="page">
<header><h1>Site name, with, commas</h1></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as every site does, and you must agree to that, please.</p></div>
<div id="wrap"><div class="post"><h2>The &amp; title</h2><p>First   paragraph, with&nbsp;a gap,
and <a href=x>a link</a> inside it, long enough to count.<p>Second &lt;one&gt;<br>after a break, also long enough to matter here.
<ul><li>point one</li><li>point two</li></ul><blockquote>Quoted words, which are of some length as well.</blockquote>
<pre>code   here</pre><form><input name=q><button>Go</button></form><p>Last, short.</p></div>
<div class="sidebar"><p>Popular, popular, popular stories that are not the article, of course.</p></div></div>
<div id="comments"><p>I disagree, strongly, with everything that was said, and I will say why at length.</p></div>
<footer>&copy; someone, 2020, all rights, reserved</footer></body></html>"""


def test_the_article_is_extracted_whole():
    want = ["The & title", "First paragraph, with a gap, and a link inside it, long enough to count.",
            "Second <one> after a break, also long enough to matter here.", "point one", "point two",
            "Quoted words, which are of some length as well.", "code here", "Last, short."]
    assert main_text(PAGE).split("\n\n") == want


@pytest.mark.parametrize("html,want", [
    (None, ""), ("", ""), ("<", "<"), ("just text", "just text"), ("<p>one<p>two", "one\n\ntwo"), ("<script>x", ""),
    ("<!-- only", ""), ("<nav><a href=x>y</a></nav>", ""), ("<div hidden>no</div><p>yes, this is the text</p>", "yes, this is the text"),
    ("<article><header><h1>Head</h1></header><p>Body of it.</p></article>", "Head\n\nBody of it."),
    ("<p>a &lt;b&gt; &#233; &eacute; &bogus; &amp;amp;</p>", "a <b> é é &bogus; &amp;"),
    ("<table><tr><td>c1<td>c2<tr><td>c3</table>", "c1\n\nc2\n\nc3")])
def test_odd_pages(html, want):
    assert main_text(html) == want


PARAS = [f"Paragraph {i} of the article, which is long enough, with commas, to count as running text." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in PARAS)


@pytest.mark.parametrize("html", [
    f"<div class='content no-sidebar'>{BODY}</div>", f"<div class='layout has-comments'>{BODY}</div>",
    f"<div id='page' class='with-banner'>{BODY}</div>", f"<div class='banner'><div>{BODY}</div></div>",
    f"<form action=x><input name=q><div>{BODY}</div></form>"])
def test_names_and_forms_around_the_article_lose_nothing(html):
    assert main_text(f"<body>{html}</body>") == "\n\n".join(PARAS)


def test_generated_ids_lose_no_section():
    html = (f"<article>{BODY}<section id='related-work'><p>Work of others.</p></section><div id='search-algorithms'>"
            "<p>How to search.</p></div><h2 id='menu-planning'>Menus</h2><p class='social-science'>Society.</p>"
            "<div class='ad'>Buy this now.</div><div class='social-share'>Tell all.</div></article>")
    assert main_text(html).split("\n\n") == [*PARAS, "Work of others.", "How to search.", "Menus", "Society."]


def test_siblings_of_the_container_stay():
    long = "".join(f"<p>{p}</p>" for p in PARAS * 3)
    html = (f"<body><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul><h1>Title</h1><div>{long}</div><h2>Points</h2>"
            "<ul><li>one</li><li>two</li></ul><blockquote>Quoted.</blockquote>Bare words.<section><p>Short.</p></section>"
            f"<ul><li><a href=/c>Share</a></ul><pre>code</pre><div>{long}</div><h3>Table</h3><table><tr><td>c1<td>c2</table>"
            "<h2>More news</h2><ul><li><a href=/d>Other</a></ul></body>")
    assert main_text(html).split("\n\n") == ["Title", *PARAS * 3, "Points", "one", "two", "Quoted.", "Bare words.", "Short.", "code",
                                             *PARAS * 3, "Table", "c1", "c2"]


def test_pages_in_spark_and_long_ones(spark):
    deep = "<div>" * 20_000 + "deep text" + "</div>" * 20_000
    many = "<article>" + "".join(f"<p>Paragraph {i}, of many, in a long page.</p>" for i in range(20_000)) + "</article>"
    data = [(1, "u", None), (2, "u", ""), (3, "u", PAGE), (3, "u", PAGE), (None, None, "<p>x"), (4, "u", deep), (5, "u", many)]
    df = spark.createDataFrame([(*r, "clash") for r in data], "page_id bigint, url string, html string, text string")
    out = extract_pages(df)
    got = out.collect()
    assert out.columns == ["page_id", "url", "text"] and len(got) == len(data)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["text"].count("\n\n") for r in got if r["page_id"] == 5] == [19_999]
    assert [r["text"] for r in got if r["page_id"] == 4] == ["deep text"]
    assert extract_pages(df.limit(0)).count() == 0


# ---- pipeline ----------------------------------------------------------------------

def test_pipeline_stages_keep_clean_documents(spark, docs, text):
    import corpus_pipeline as P

    shared = "This very line is found in many of the documents"
    data = [(i, f"{text(i, 60)}\n{shared}\n{text(i + 500, 30)}", "en", f"s{i % 2}") for i in range(40)]
    near = data[0][1].replace("\n", " ")
    data += [(100, near + " end", "en", "s0"), (101, near + " other end", "en", "s1"), (102, "1234 %%", "en", "s0"),
             (103, None, "en", "s0"), (None, text(77, 50), "en", None), (104, text(88, 50), "en", "s0"), (104, text(88, 50), "en", "s0")]
    cur = docs(data)
    kept = {}
    for name, step in P.STAGES:
        out = step(spark, cur, None)
        if name != "packing":
            assert out.columns == cur.columns
            cur = P.stage(out)
        kept[name] = cur
    ids = {k: [r["doc_id"] for r in v.collect()] for k, v in kept.items()}
    assert sorted(map(repr, ids["language_id"])) == sorted(repr(r[0]) for r in data if r[0] not in (102, 103))
    assert sorted(map(repr, ids["line_dedup"])) == sorted(map(repr, ids["language_id"]))
    assert kept["line_dedup"].filter(F.col("text").contains(shared)).select("doc_id").distinct().count() == 3  # once as a line, twice inside a line
    assert sorted(map(repr, ids["near_dedup"])) == sorted(repr(r[0]) for r in data[:40] + [(None,), (104,)])
    assert all(Counter(map(repr, ids["mixing"]))[x] <= 2 for x in map(repr, ids["near_dedup"]))
    tokens = out.agg(F.sum("length")).first()[0]
    bpe = Bpe(JSON, RANKS)
    assert tokens == sum(len(bpe.encode(r["text"] or "")) // 2 + 1 for r in kept["mixing"].collect())


def test_the_pipeline_runs_on_a_table(spark, tmp_path):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    out = P.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and re.fullmatch(r"\d+", str(out.agg(F.max("sequence_id")).first()[0]))


def test_sums_beyond_the_code_come_back_as_one_row_per_piece(docs, text, monkeypatch):
    """Not as one row per document and part of the subtrees, which grow together."""
    monkeypatch.setattr(S, "PARTS", 40)
    monkeypatch.setattr(S, "PART", 1)
    made = []
    beyond = S._beyond

    def watched(tree, code, walked):
        real = type(walked).mapInPandas
        with monkeypatch.context() as m:
            m.setattr(type(walked), "mapInPandas", lambda df, fn, kind: made.append(real(df, fn, kind)) or made[-1])
            out = beyond(tree, code, walked)
        return out

    monkeypatch.setattr(S, "_beyond", watched)
    data = [(i, text(i, 60 + i % 30)) for i in range(300)]
    got = score_documents(docs(data).coalesce(1), F.lit(True), gain=4.0, cells=0).collect()
    assert len(got) == 300
    assert made[0].count() <= 300 + 40  # one block of documents: a row each, and one for each part
