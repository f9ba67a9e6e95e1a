"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its lower-cased words joined by one space and closed by an end symbol. The tree's
states are contexts of up to DEPTH preceding bytes. A context is kept if it pays: its
next-symbol distribution differs from that of its longest proper suffix by enough bits
(count times divergence). Distributions are smoothed towards the suffix's, and every symbol is
predicted by the longest kept suffix of what stands before it.

Counts are shuffled once, by the last three bytes of the context, so that a task holds whole
subtrees: sorted with the newest byte first, the contexts of every depth are runs of one array.
Contexts of up to two bytes (at most 65,793 of them) are a table of their own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import stage

DEPTH = 6  # longest context in bytes
GAIN = 4.0  # bits that a context must save
PULL = 6.0  # weight of the suffix's distribution for each different symbol met
CELLS = 1 << 23  # states times symbols that travel with the code (8 bytes each)
HOT = 2.0**-20  # share of training tokens from which on a word travels with the code
HOT_BYTES = 64  # longest such word
CHUNK = 1 << 20  # bytes in work at once
FLUSH = 1 << 18  # words of a task's count table before it is handed on
HELD = 1 << 21  # symbols that a counting task sorts before it hands them on
BLOCK = 1 << 20  # symbols beyond the code that a scoring task sorts at once
SPAN = 1 << 24  # bytes of text that one block of them comes from at most, but for a longer text
PART = 1 << 22  # training bytes for each part of the subtrees
SCORED_AT_ONCE = 4  # parts that a scoring task takes one after the other, so that fewer sums per document come back
PARTS = 1 << 14  # most parts
END = b"\n"  # cannot occur in a text whose white space is folded
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def tokens(text: str | None) -> list[bytes]:
    """Words between [\\x20\\x09-\\x0D], A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first row, token lists) for stretches of about CHUNK characters, so that the tokens in
    memory do not grow with an Arrow batch."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held < CHUNK):
            held += len(texts[b] or "")
            b += 1
        yield a, [tokens(t) for t in texts[a:b]]
        a = b


def _streams(texts: list[list[bytes]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of token lists: (first, last + 1, bytes with DEPTH ends before each text, first symbol of each)."""
    a = 0
    while a < len(texts):
        parts, at, held, b = [], [], 0, a
        while b < len(texts) and (b == a or held < CHUNK):
            body = b" ".join(texts[b]) + END
            parts += [END * DEPTH, body]
            at.append(held + DEPTH)
            held += DEPTH + len(body)
            b += 1
        yield a, b, np.frombuffer(b"".join(parts), np.uint8), np.array(at)
        a = b


def _keys(buf: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """The turned (context, symbol) key of every symbol of a stream: newest byte of the context highest."""
    real = np.ones(len(buf), bool)
    for k in range(1, DEPTH + 1):
        real[at - k] = False
    for lo in range(DEPTH, len(buf), CHUNK):
        hi = min(len(buf), lo + CHUNK)
        key = np.zeros(hi - lo, np.int64)
        for k in range(1, DEPTH + 1):
            key |= buf[lo - k:hi - k]
            key <<= 8
        key |= buf[lo:hi]
        yield key[real[lo:hi]]


def _runs(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts."""
    k = np.sort(np.concatenate(keys))
    first = _firsts(k)
    return k[first], np.diff(np.append(first, len(k)))


def _grams(buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct (context, symbol) keys and counts of a stream as ``grow_tree`` takes them, oldest byte highest."""
    for key in _keys(buf, at):
        k, n = _runs([key])
        yield _turn(k), n


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, n = k[order], n[order]
    first = _firsts(k)
    return k[first], np.add.reduceat(n, first)


def _firsts(k: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, k[1:] != k[:-1]))


def _turn(key: np.ndarray) -> np.ndarray:
    """(context, symbol) keys with the context's bytes the other way round."""
    ctx = (key >> 8).byteswap().view(np.uint64) >> np.uint64(64 - 8 * DEPTH)
    return (ctx.astype(np.int64) << 8) | (key & 255)


def _part(key: np.ndarray, parts: int) -> np.ndarray:
    """Part of turned keys, by the three newest bytes."""
    top = (key >> 8 * (DEPTH - 2)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((top >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _press(keys: np.ndarray, *more: np.ndarray) -> bytes:
    """Keys, as steps, and other integers, compressed byte plane by byte plane."""
    if not len(keys):
        return b""
    cols = [np.diff(keys, prepend=np.int64(0)), *more]
    planes = b"".join(np.ascontiguousarray(c, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for c in cols)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def _unpress(body: bytes, width: int) -> list[np.ndarray]:
    if not body:
        return [np.zeros(0, np.int64)] * width
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(width, 8, -1)
    cols = [np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes]
    return [np.cumsum(cols[0]), *cols[1:]]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, "<f4").view("<i4").astype(np.int64)


def _floats(x: np.ndarray) -> np.ndarray:
    return x.astype("<i4").view("<f4").astype(float)


def _split(key: np.ndarray, of: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Ascending turned keys and a number for each, pressed part by part."""
    part = _part(key, parts).astype(np.uint16)
    order = np.argsort(part, kind="stable")
    key, of, part = key[order], of[order], part[order]
    first = _firsts(part)
    for a, b in zip(first, [*first[1:], len(part)]):
        yield int(part[a]), _press(key[a:b], of[a:b])


_COUNTS = "part int, word binary, n long, body binary"


def _gram_rows(key: np.ndarray, n: np.ndarray, parts: int) -> pd.DataFrame:
    rows = list(_split(key, n, parts))
    return pd.DataFrame({"part": [p for p, _ in rows], "word": None, "n": None, "body": [b for _, b in rows]})


def _combine(counted: DataFrame, parts: int) -> DataFrame:
    """Staged counts: (word, n) rows and one row (part, body) for the grams of each part."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        part, held = None, 0
        for pdf in batches:
            for p, word, body in zip(pdf["part"], pdf["word"], pdf["body"]):
                part = int(p)
                if word is not None:
                    c, = _unpress(bytes(body), 1)
                    for w, x in zip(zstandard.ZstdDecompressor().decompress(bytes(word)).split(), c.tolist()):
                        words[w] += x
                    continue
                k, c = _unpress(bytes(body), 2)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > HELD and held > 2 * len(keys[0]):
                    k, c = _merge(keys, counts)
                    keys, counts, held = [k], [c], len(k)
        if words:
            yield pd.DataFrame({"part": part, "word": list(words), "n": list(words.values()), "body": None})
        if keys:
            yield pd.DataFrame({"part": [part], "word": None, "n": None, "body": [_press(*_merge(keys, counts))]})

    return stage(counted.repartitionById(parts, F.col("part")).mapInPandas(run, _COUNTS))


def count_corpus(docs: DataFrame, text_col: str, parts: int) -> DataFrame:
    """Staged counts over all rows: (word, n) and, for each part of the subtrees, its pressed grams.

    Both are combined in the task that reads the texts, then once more after the only shuffle.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        keys: list[np.ndarray] = []
        held = 0

        def word_rows() -> pd.DataFrame:
            dealt: dict[int, list[bytes]] = {}
            for w in words:
                dealt.setdefault(zlib.crc32(w) % parts, []).append(w)
            for w in dealt.values():
                w.sort()
            pack = zstandard.ZstdCompressor(level=1).compress
            return pd.DataFrame({"part": list(dealt), "word": [pack(b" ".join(w)) for w in dealt.values()], "n": None,
                                 "body": [_press(np.array([words[x] for x in w])) for w in dealt.values()]})

        for pdf in batches:
            for _, toks in _slices(pdf["text"].tolist()):
                for t in toks:
                    words.update(t)
                for _, _, buf, at in _streams(toks):
                    for key in _keys(buf, at):
                        keys.append(key)
                        held += len(key)
                        if held > HELD:
                            yield _gram_rows(*_runs(keys), parts)
                            keys, held = [], 0
                if len(words) > FLUSH:
                    yield word_rows()
                    words.clear()
        if words:
            yield word_rows()
        if keys:
            yield _gram_rows(*_runs(keys), parts)

    return _combine(docs.select(F.col(text_col).alias("text")).mapInPandas(run, _COUNTS), parts)


@dataclass
class SuffixTree:
    """child[state * width + class of the byte before] is the longer state, 0 if there is none and
    -1 if it is among ``rest``; logp[state * width + class of the symbol] is its log10 probability.

    rest holds the kept contexts of three bytes and more, a row for each part of the subtrees;
    those of a level of frequency below ``low`` are not in the code. It is None if there are none.
    """

    classes: np.ndarray
    child: np.ndarray
    logp: np.ndarray
    width: int
    rest: DataFrame | None = None
    low: float = -math.inf
    parts: int = 1

    def __getstate__(self) -> dict:
        """Compressed on its way to the workers; most cells of ``child`` are 0."""
        pack = zstandard.ZstdCompressor(level=1).compress
        return {**vars(self), "child": pack(self.child.tobytes()), "logp": pack(self.logp.tobytes())}

    def __setstate__(self, state: dict) -> None:
        unpack = zstandard.ZstdDecompressor().decompress
        vars(self).update(state, child=np.frombuffer(unpack(state["child"]), np.int32),
                          logp=np.frombuffer(unpack(state["logp"]), np.float32))

    def walk(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of every text of a stream but for the symbols whose context goes on
        among ``rest``; the number of the text and the (context, symbol) key of each of those."""
        cls = self.classes.astype(np.int32)[buf]
        real = np.ones(len(buf), bool)
        for k in range(1, DEPTH + 1):
            real[at - k] = False
        out = np.zeros(len(buf))
        left = []
        width = np.int32(self.width)
        for lo in range(DEPTH, len(buf), CHUNK):
            hi = min(len(buf), lo + CHUNK)
            state = np.zeros(hi - lo, np.int32)
            on, now = np.flatnonzero(real[lo:hi]).astype(np.int32), np.int32(0)
            for k in range(1, DEPTH + 1):
                to = self.child.take(now * width + cls[lo - k:hi - k].take(on))
                left.append(lo + on[to < 0].astype(np.int64))
                go = np.flatnonzero(to > 0)
                on, now = on.take(go), to.take(go)
                state[on] = now
            out[lo:hi] = self.logp.take(state * width + cls[lo:hi])
        out[~real] = 0.0
        pos = np.sort(np.concatenate(left)) if left else np.zeros(0, np.int64)
        out[pos] = 0.0
        key = np.zeros(len(pos), np.int64)
        for k in range(1, DEPTH + 1):
            key |= buf[pos - k]
            key <<= 8
        key |= buf[pos]
        return np.add.reduceat(out, at), np.searchsorted(at, pos, "right") - 1, key

    def score(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of every text of a stream, if the tree has no ``rest``."""
        return self.walk(buf, at)[0]

    def place(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of the symbol after the longest context held here, for turned keys."""
        state = np.zeros(len(key), np.int32)
        on = np.arange(len(key))
        for k in range(1, DEPTH + 1):
            to = self.child[state[on] * self.width + self.classes[(key[on] >> 8 * (DEPTH + 1 - k)) & 255]]
            go = to > 0
            on = on[go]
            state[on] = to[go]
        return self.logp[state * self.width + self.classes[key & 255]].astype(float)


@dataclass
class _Top:
    """Contexts of d = 0, 1, 2 bytes: ascending turned names, counts and probabilities by class of symbol."""

    classes: np.ndarray
    names: list[np.ndarray]
    n: list[np.ndarray]
    all: list[np.ndarray]
    back: list[np.ndarray]
    p: list[np.ndarray]
    pays: list[np.ndarray]

    @classmethod
    def of(cls, key: np.ndarray, count: np.ndarray, gain: float) -> _Top:
        """From turned keys of two bytes and a symbol."""
        symbols = np.unique(key & 255)
        classes = np.zeros(256, np.int64)  # class 0: bytes that training never met
        classes[symbols] = np.arange(1, len(symbols) + 1)
        top = cls(classes, [], [], [], [], [], [])
        for d in range(3):
            ctx = key >> 8 * (3 - d)
            names, row = np.unique(ctx, return_inverse=True)
            n = np.zeros((len(names), len(symbols) + 1))
            np.add.at(n, (row, classes[key & 255]), count)
            total, pull = n.sum(1), PULL * (n > 0).sum(1)
            if d:
                up = np.searchsorted(top.names[-1], names >> 8)
                p = top.p[-1][up]
                with np.errstate(divide="ignore", invalid="ignore"):
                    bits = n * (np.log2(n / total[:, None]) - np.log2(top.n[-1][up] / top.all[-1][up][:, None]))
                pays = np.nansum(bits, 1) >= gain
            else:
                p, pays = np.full(n.shape, 1 / 256), np.ones(1, bool)
            # the more symbols were met, the likelier is another
            for held, x in zip((top.names, top.n, top.all, top.back, top.p, top.pays),
                               (names, n, total, pull / (total + pull), (n + pull[:, None] * p) / (total + pull)[:, None], pays)):
                held.append(x)
        return top


def _subtrees(key: np.ndarray, n: np.ndarray, top: _Top, gain: float) -> list[dict[str, np.ndarray]]:
    """Kept contexts of 3 to DEPTH bytes of a part, from all of its counts."""
    tables = [(key, n)]
    for _ in range(DEPTH - 3):
        k, n = tables[-1]
        tables.append(_merge([(k >> 16 << 8) | (k & 255)], [n]))
    found: list[dict[str, np.ndarray]] = []
    for d, (k, n) in zip(range(3, DEPTH + 1), reversed(tables)):
        first = _firsts(k >> 8)
        kinds = np.diff(np.append(first, len(k)))
        name, total, pull = k[first] >> 8, np.add.reduceat(n, first), PULL * kinds
        of = np.repeat(np.arange(len(first)), kinds)
        if d == 3:
            up = np.searchsorted(top.names[2], name >> 8)
            cls = top.classes[k & 255]
            up_n, up_all, up_p = top.n[2][up[of], cls], top.all[2][up], top.p[2][up[of], cls]
        else:
            last = found[-1]
            up = np.searchsorted(last["name"], name >> 8)
            at = np.searchsorted(last["key"], (k >> 16 << 8) | (k & 255))
            up_n, up_all, up_p = last["n"][at], last["all"][up], last["p"][at]
        bits = n * (np.log2(n / total[of]) - np.log2(up_n / up_all[of]))
        found.append({"name": name, "all": total, "back": pull / (total + pull), "up": up, "key": k, "n": n, "of": of,
                      "p": (n + pull[of] * up_p) / (total + pull)[of], "keep": np.add.reduceat(bits, first) >= gain})
    for long, short in zip(found[:0:-1], found[-2::-1]):
        short["keep"][long["up"][long["keep"]]] = True  # suffixes of kept contexts are kept
    return found


_MODEL = "part int, ctx array<binary>, seen array<binary>, up array<long>, level array<int>, size array<long>"


def _grow_parts(grams: DataFrame, top: _Top, gain: float) -> DataFrame:
    """Staged model: for each part and depth the kept contexts with step back and level of
    frequency, and the symbols met after them with their log10 probability."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, body in zip(pdf["part"], pdf["body"]):
                ctx, seen, levels = [], [], []
                found = _subtrees(*_unpress(bytes(body), 2), top, gain)
                up = np.unique(found[0]["name"][found[0]["keep"]] >> 8)
                while found:
                    t = found.pop(0)
                    keep, of = t["keep"], t["of"]
                    levels.append(np.floor(8 * np.log2(t["all"][keep])).astype(np.int64))
                    ctx.append(_press(t["name"][keep], _bits(np.log10(t["back"][keep])), levels[-1]))
                    seen.append(_press(t["key"][keep[of]], _bits(np.log10(t["p"][keep[of]]))))
                level, size = np.unique(np.concatenate(levels), return_counts=True)
                yield pd.DataFrame({"part": [part], "ctx": [ctx], "seen": [seen], "up": [up], "level": [level.astype(np.int32)],
                                    "size": [size]})

    return stage(grams.mapInPandas(run, _MODEL))


def _hot_parts(model: DataFrame, low: float) -> pd.DataFrame:
    """(d, ctx, seen, on): contexts from level ``low`` on, and those below it whose suffix is in the code."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ctxs, seens in zip(pdf["ctx"], pdf["seen"]):
                short = None
                for d, (ctx, seen) in enumerate(zip(ctxs, seens), 3):
                    name, back, level = _unpress(bytes(ctx), 3)
                    key, lp = _unpress(bytes(seen), 2)
                    hot = level >= low
                    mine = np.isin(key >> 8, name[hot])
                    on = name[~hot] if d == 3 else name[~hot & np.isin(name >> 8, short)]
                    short = name[hot]
                    if len(short) or len(on):
                        yield pd.DataFrame({"d": [d], "ctx": [_press(name[hot], back[hot])],
                                            "seen": [_press(key[mine], lp[mine])], "on": [_press(on)]})

    return model.select("ctx", "seen").mapInPandas(run, "d int, ctx binary, seen binary, on binary").toPandas()


def grow_tree(grams: DataFrame, gain: float = GAIN, cells: int = CELLS, parts: int = 8) -> SuffixTree:
    """The tree from (gram, n) counts of the deepest contexts with their next symbol, oldest byte highest."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _gram_rows(*_merge([_turn(pdf["gram"].to_numpy(np.int64))], [pdf["n"].to_numpy(np.int64)]), parts)

    return _grow(_combine(grams.select("gram", "n").mapInPandas(run, _COUNTS), parts).filter("body is not null"), gain, cells, parts)


def _grow(grams: DataFrame, gain: float, cells: int, parts: int) -> SuffixTree:
    """The tree from the staged grams of all parts.

    Shorter contexts' counts are sums of deeper ones. A context c is kept if
    sum over symbols of n(c, s) log2(P(s | c) / P(s | suffix of c)) >= gain;
    suffixes of kept contexts are kept. ``gain`` is a number of bits whatever the size of the
    corpus, so more text keeps more contexts. Contexts of up to two bytes and the most frequent of
    the others, up to ``cells`` cells of state times symbol, travel with the code: that saves
    shuffles and changes no score. All others are in ``rest``.
    """
    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for body in pdf["body"]:
                k, n = _unpress(bytes(body), 2)
                k, n = _merge([(k >> 8 * (DEPTH - 1) << 8) | (k & 255)], [n])
                yield pd.DataFrame({"k": k, "n": n})

    pairs = (grams.select("body").mapInPandas(short, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
             .toArrow().to_pandas())
    if not len(pairs):
        return SuffixTree(np.zeros(256, np.int64), np.zeros(1, np.int32), np.full(1, math.log10(1 / 256), np.float32), 1)
    top = _Top.of(pairs["k"].to_numpy(np.int64), pairs["n"].to_numpy(np.int64), gain)
    width = top.p[0].shape[1]
    model = _grow_parts(grams.select("part", "body"), top, gain)

    keep = top.pays
    longer = model.select(F.explode("up").alias("up")).distinct().toPandas()["up"].to_numpy(np.int64)
    keep[2][np.searchsorted(top.names[2], longer)] = True
    keep[1][np.searchsorted(top.names[1], top.names[2][keep[2]] >> 8)] = True

    # the code takes the upper levels of frequency; a suffix is at least as frequent as its context
    levels = (model.select(F.explode(F.arrays_zip("level", "size")).alias("x")).groupBy("x.level")
              .agg(F.sum("x.size").alias("n")).collect())
    room, low, taken = cells // width - 1 - int(keep[1].sum() + keep[2].sum()), math.inf, 0
    for level, n in sorted(map(tuple, levels), reverse=True):
        if taken + n > room:
            break
        low, taken = level, taken + n
    parts_of = _hot_parts(model, low)

    names = [np.zeros(1, np.int64), top.names[1][keep[1]], top.names[2][keep[2]]]
    backs = [None, *(np.log10(top.back[d][keep[d]]) for d in (1, 2))]
    for d in range(3, DEPTH + 1):
        held = [_unpress(bytes(x), 2) for x in parts_of["ctx"][parts_of["d"] == d]]
        name = np.concatenate([x[0] for x in held] or [np.zeros(0, np.int64)])
        order = np.argsort(name)
        names.append(name[order])
        backs.append(_floats(np.concatenate([x[1] for x in held] or [np.zeros(0, np.int64)]))[order])
    base = np.zeros(len(names) + 1, np.int64)
    base[1:] = np.cumsum([len(k) for k in names])
    child = np.zeros(base[-1] * width, np.int32)
    logp = np.zeros((base[-1], width), np.float32)
    logp[0] = np.log10(top.p[0][0])
    for d in range(1, DEPTH + 1):
        parent = base[d - 1] + np.searchsorted(names[d - 1], names[d] >> 8)
        child[parent * width + top.classes[names[d] & 255]] = base[d] + np.arange(len(names[d]))
        if d < 3:
            logp[base[d]:base[d + 1]] = np.log10(top.p[d][keep[d]])
            continue
        logp[base[d]:base[d + 1]] = backs[d][:, None] + logp[parent]
        for seen, on in parts_of[["seen", "on"]][parts_of["d"] == d].itertuples(index=False):
            key, lp = _unpress(bytes(seen), 2)
            logp[base[d] + np.searchsorted(names[d], key >> 8), top.classes[key & 255]] = _floats(lp)
            on, = _unpress(bytes(on), 1)  # where a context goes on outside the code
            child[(base[d - 1] + np.searchsorted(names[d - 1], on >> 8)) * width + top.classes[on & 255]] = -1
    rest = model.select("part", "ctx", "seen") if sum(n for _, n in map(tuple, levels)) > taken else None
    return SuffixTree(top.classes, child, logp.ravel(), width, rest, low, parts)


_SCORED = "rid long, id string, trained boolean, n_tokens long, known long, base double, score double, rare binary"
_FIELDS = [c.split()[0] for c in _SCORED.split(", ")]


def _beyond(tree: SuffixTree, code: Broadcast, walked: DataFrame) -> DataFrame:
    """One row per document of ``walked``, with the log10 probabilities of the symbols in its blocks, whose context goes
    on among the tree's rest, added to ``score``.

    A part's model comes before its pieces of blocks, which pass one by one: each different key
    takes the contexts beyond the code from short to long, the symbol's own entry or the step back
    added to what came before. A piece returns one row, the pressed sums of its documents; they
    meet the documents of their block, ``src``, which are added up one block after the other.
    """
    low, tasks = tree.low, max(1, tree.parts // SCORED_AT_ONCE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, model = None, []
        for pdf in batches:
            docs = pdf[pdf["n_tokens"].notna()]
            if len(docs):
                yield docs[[*_FIELDS, "src"]].assign(part=None, body=None)
            srcs, at_part, sums = [], [], []
            for p, ctxs, seens, body, src in zip(pdf["part"], pdf["ctx"], pdf["seen"], pdf["body"], pdf["src"]):
                if p != part:
                    part, model = p, []
                if ctxs is not None:
                    for d, (ctx, seen) in enumerate(zip(ctxs, seens), 3):
                        name, back, level = _unpress(bytes(ctx), 3)
                        key, lp = _unpress(bytes(seen), 2)
                        cold = level < low
                        mine = np.isin(key >> 8, name[cold])
                        if cold.any():
                            model.append((d, name[cold], _floats(back[cold]), key[mine], _floats(lp[mine])))
                if body is None:
                    continue
                key, rid = _unpress(bytes(body), 2)
                first = _firsts(key)
                one = key[first]
                lp = code.value.place(one)
                for d, name, back, seen, own in model:
                    ctx = one >> 8 * (DEPTH + 1 - d)
                    at = np.minimum(np.searchsorted(name, ctx), len(name) - 1)
                    hit = np.flatnonzero(name[at] == ctx)
                    want = (ctx[hit] << 8) | (one[hit] & 255)
                    to = np.minimum(np.searchsorted(seen, want), len(seen) - 1)
                    lp[hit] = np.where(seen[to] == want, own[to], lp[hit] + back[at[hit]])
                who, of = np.unique(rid, return_inverse=True)
                srcs.append(src)
                at_part.append(p)
                sums.append(_press(who, np.bincount(of, np.repeat(lp, np.diff(np.append(first, len(key))))).view(np.int64)))
            if srcs:
                yield pd.DataFrame({**dict.fromkeys(_FIELDS), "src": srcs, "part": at_part, "body": sums})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        src, held, rid, total = None, [], None, None

        def documents() -> pd.DataFrame:
            nonlocal held, rid, total
            whole = held[0] if len(held) == 1 else pd.concat(held).sort_values("rid")
            held, rid, total = [whole], whole["rid"].to_numpy(np.int64), whole["score"].to_numpy(float).copy()
            return whole

        for pdf in batches:
            for now, rows in pdf.groupby("src"):
                if now != src and held:
                    yield (documents() if total is None else held[0]).assign(score=total)
                if now != src:
                    src, held, total = now, [], None
                docs = rows[rows["body"].isna()]
                if len(docs):
                    held.append(docs[_FIELDS].sort_values("rid"))
                for body in rows["body"].dropna():
                    if total is None:
                        documents()
                    who, x = _unpress(bytes(body), 2)
                    total[np.searchsorted(rid, who)] += x.view(float)
        if held:
            yield (documents() if total is None else held[0]).assign(score=total)

    none = F.lit(None)
    rows = (walked.withColumn("ctx", none.cast("array<binary>")).withColumn("seen", none.cast("array<binary>"))
            .unionByName(tree.rest, allowMissingColumns=True)
            .repartitionById(tasks, F.col("part") % tasks).sortWithinPartitions("part", F.col("ctx").isNull())
            .mapInPandas(run, f"{_SCORED}, src long, part int, body binary"))
    # documents before sums, sums by part, so that reruns add in the same order
    return (rows.repartition("src").sortWithinPartitions("src", F.col("body").isNotNull(), "part").mapInPandas(add, _SCORED))


def score_documents(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text",
                    gain: float = GAIN, cells: int = CELLS) -> DataFrame:
    """One row per input row: id, trained, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows where ``training`` holds, all of them and whole, and scores every
    row. Tokens are the words and one end. base_score is the smoothed unigram log10
    probability, score the suffix tree's of the same text. Null text is empty: one end token.
    Repeated rows count and are scored each. A null ``training`` is false. Without training
    rows every byte has probability 1/256. Other columns are ignored; an empty table gives an
    empty one.

    Words above the share HOT of the training tokens, at most 1 / HOT of them, travel with the
    code; all other words meet their counts by a join, so the vocabulary may grow freely.
    The same holds for the tree: symbols whose context goes on beyond the states in the code
    are sent, packed, to the part of the subtrees that holds it, and only sums come back.
    """
    # ids travel as text: pandas would turn integers beside a null into floats
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"),
                      F.coalesce(training, F.lit(False)).alias("trained"))
    learn = src.filter("trained")
    n_docs, size = learn.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    parts = min(PARTS, max(8, (size or 0) // PART))
    counts = count_corpus(learn, "text", parts)
    vocab = counts.filter("word is not null").select("word", F.col("n").alias("c"))
    v = vocab.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_all, kinds = (v["n"] or 0) + n_docs, v["v"] + (n_docs > 0)
    floor = n_all + 0.5 * (kinds + 1)
    tree = _grow(counts.filter("body is not null"), gain, cells, parts)
    code = docs.sparkSession.sparkContext.broadcast(replace(tree, rest=None))  # bounded by CELLS
    often = vocab.filter((F.col("c") >= max(1.0, HOT * n_all)) & (F.octet_length("word") <= HOT_BYTES)).toPandas()
    hot = dict(zip(map(bytes, often["word"]), np.log10((often["c"] + 0.5) / floor).tolist()))
    end_score = math.log10((n_docs + 0.5) / floor)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = hot.get
        keys: list[np.ndarray] = []
        rids: list[np.ndarray] = []
        held, span, src = 0, 0, None

        def block_rows() -> pd.DataFrame:
            key = np.concatenate(keys)
            order = np.argsort(key)
            rows = list(_split(key[order], np.concatenate(rids)[order], parts))
            return pd.DataFrame({**dict.fromkeys(_FIELDS), "part": [p for p, _ in rows], "body": [b for _, b in rows],
                                 "src": src})

        for pdf in batches:
            for first, toks in _slices(pdf["text"].tolist()):
                rows = pdf.iloc[first:first + len(toks)]
                rid = rows["rid"].to_numpy(np.int64)
                score, block = np.zeros(len(toks)), np.zeros(len(toks), np.int64)
                for a, b, buf, at in _streams(toks):
                    src = rid[a] if src is None else src  # a block is named after its first document
                    block[a:b] = src
                    score[a:b], of, key = code.value.walk(buf, at)
                    keys.append(key)
                    rids.append(rid[a + of])
                    held += len(key)
                    span += len(buf)
                    if held > BLOCK or span > SPAN:
                        if held:
                            yield block_rows()
                        keys, rids, held, span, src = [], [], 0, 0, None
                sums, known, rare = [], [], []
                for t in toks:
                    got = list(map(get, t))
                    cold = [w for w, x in zip(t, got) if x is None] if None in got else []
                    if cold:
                        got = [x for x in got if x is not None]
                    sums.append(math.fsum(got) + end_score)
                    known.append(len(got) + (n_docs > 0))
                    rare.append(b" ".join(cold) or None)
                yield pd.DataFrame({"rid": rid, "id": rows["id"].to_numpy(), "trained": rows["trained"].to_numpy(),
                                    "n_tokens": [len(t) + 1 for t in toks], "known": known, "base": sums,
                                    "score": score, "rare": rare, "part": rid % parts, "body": None, "src": block})
        if held:
            yield block_rows()

    walked = src.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(run, f"{_SCORED}, part int, body binary, src long")
    scored = stage(walked.drop("part", "body", "src") if tree.rest is None else _beyond(tree, code, walked))
    scored = scored.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    cold = (scored.select("rid", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("word"))
            .withColumn("word", F.col("word").cast("binary")).join(vocab, "word", "left").groupBy("rid")
            .agg(F.sum(F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.5)) / F.lit(floor))).alias("more"),
                 F.count("c").alias("more_known")))
    return scored.drop("rare").join(cold, "rid", "left").select(
        "id", "trained", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
