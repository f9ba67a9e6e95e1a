"""Near-duplicate documents by SetSketch registers.

A document's set of word shingles becomes m registers: each register takes the smallest of
the set's exponential draws, on a scale of powers of a base close to one, cut to 16 bits.
Registers of a union are the larger ones of its parts, and two sets agree in a register with
a probability that follows their Jaccard similarity. Bands of registers propose pairs, a
joint likelihood of all registers screens them, and the full sets decide.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import components, stage

M = 128  # registers
BAND = 4  # registers per band: at similarity 0.75 all 32 bands differ with probability 5e-6
BASE = 1.001  # scale of the registers
RATE = 20.0  # rate of the exponential draws
TOP = 65535  # largest register value
BLOCK = 1024  # rows per side of one in-task comparison
CHUNK_BYTES = 4 << 20  # bytes of text hashed at once

_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser by shifts and odd multipliers, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles (fewer words: the whole sequence)."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    held = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass").translate(_FOLD)
        group.append(raw)
        held += len(raw)
        if held >= CHUNK_BYTES:
            out += _hash_group(group, words)
            group, held = [], 0
    return out + _hash_group(group, words)


def _hash_group(raws: list[bytes], words: int) -> list[np.ndarray]:
    if not raws:
        return []
    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raws])
    space = _SPACE[buf]
    at = np.flatnonzero(~space)
    if not len(at):
        return [np.zeros(0, np.uint64) for _ in raws]
    first = at[np.flatnonzero(np.diff(at, prepend=-2) > 1)]
    lens = np.diff(np.append(np.flatnonzero(np.diff(at, prepend=-2) > 1), len(at)))
    place = (at - np.repeat(first, lens)).astype(np.uint64)  # of each byte in its word
    place <<= np.uint64(8)
    place |= buf[at]
    place += np.uint64(0x9E3779B97F4A7C15)
    word = np.add.reduceat(_mix(place), np.cumsum(lens) - lens)
    _mix(word)
    bounds = np.searchsorted(first, ends)  # words before the end of each text
    starts = np.append(0, bounds[:-1])
    k = np.uint64(0x9FB21C651E98DF25)
    full = len(word) - words + 1
    if full > 0:
        sh = word[:full].copy()
        for j in range(1, words):
            sh *= k
            sh += word[j:full + j]
        _mix(sh)
    out = []
    for a, b in zip(starts.tolist(), bounds.tolist()):
        if b - a >= words:
            out.append(np.unique(sh[a:b - words + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)  # a short sequence never meets a full shingle
            for w in word[a:b]:
                h = h * k + w
            out.append(_mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    x = _mix(np.arange(1, 2 * m + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:m], x[m:] | np.uint64(1)


def registers(sets: list[np.ndarray], m: int = M) -> np.ndarray:
    """(len(sets), m) registers; the row of an empty set is 0."""
    sizes = np.array([len(s) for s in sets], np.int64)
    regs = np.zeros((len(sets), m), np.uint16)
    rows = np.flatnonzero(sizes)
    xor, mul = _seeds(m)
    a = 0
    while a < len(rows):  # chunks that stay in the processor's cache
        b, n = a, 0
        while b < len(rows) and (b == a or n + sizes[rows[b]] <= 1 << 16):
            n += sizes[rows[b]]
            b += 1
        some = rows[a:b]
        flat = np.concatenate([sets[i] for i in some])
        at = np.cumsum(sizes[some]) - sizes[some]
        low = np.empty((m, len(some)), np.uint64)
        tmp = np.empty_like(flat)
        for j in range(m):
            np.bitwise_xor(flat, xor[j], out=tmp)
            np.multiply(tmp, mul[j], out=tmp)
            low[j] = np.minimum.reduceat(tmp, at)
        # the smallest uniform gives the smallest exponential draw; its logarithm is the register
        u = (low >> np.uint64(11)).astype(np.float64)
        h = -np.log1p(-(u + 0.5) / 2.0**53) / RATE
        regs[some] = np.clip(np.floor(1.0 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16).T
        a = b
    return regs


def jaccard_estimate(na: np.ndarray, nb: np.ndarray, above: np.ndarray, below: np.ndarray, m: int = M) -> np.ndarray:
    """Most likely Jaccard similarity given both sizes and in how many registers a set is above or below.

    With shares u and v of the joint size and a base close to one, a register of A is above
    B's with probability u - v J, below with v - u J, and equal with J. The maximum of
    above ln(u - v J) + below ln(v - u J) + equal ln J is the smaller root of a quadratic.
    """
    u = na / (na + nb)
    v = 1.0 - u
    equal = m - above - below
    a = u * v * m
    b = equal * (u * u + v * v) + above * v * v + below * u * u
    root = np.sqrt(np.maximum(b * b - 4.0 * a * equal * u * v, 0.0))
    return np.minimum((b - root) / (2.0 * a), np.minimum(u / v, v / u))


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, m: int = M) -> DataFrame:
    """(rid, id, th, n, digest, regs) per row, staged: rid numbers the rows, digest names the set."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = shingle_hashes(pdf["text"].tolist(), words)
            regs = registers(sets, m)
            yield pd.DataFrame({
                "id": pdf["id"], "th": pdf["th"], "n": [len(s) for s in sets],
                "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                "regs": [r.astype(">u2").tobytes() for r in regs]})

    # ids travel as text: pandas would turn integers beside a null into floats
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("th"),
                      F.col(text_col).alias("text"))
    out = src.mapInPandas(run, "id string, th long, n long, digest binary, regs binary")
    return stage(out.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
                 .withColumn("rid", F.monotonically_increasing_id()))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose full sets overlap enough: 100 * shared >= percent * union."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["sa"], pdf["sb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]]

    got = (pairs.join(sets.select(F.col("rid").alias("a"), F.col("set").alias("sa")), "a")
           .join(sets.select(F.col("rid").alias("b"), F.col("set").alias("sb")), "b"))
    return stage(got.select("a", "b", "sa", "sb").mapInPandas(run, "a long, b long"))


def _screen(pairs: DataFrame, reps: DataFrame, floor: float) -> DataFrame:
    """Drop pairs that sizes rule out or whose likeliest similarity is below ``floor``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack([np.frombuffer(r, ">u2") for r in pdf["ra"]])
                y = np.stack([np.frombuffer(r, ">u2") for r in pdf["rb"]])
                j = jaccard_estimate(pdf["na"].to_numpy(float), pdf["nb"].to_numpy(float),
                                     (x > y).sum(1), (x < y).sum(1), x.shape[1])
                pdf = pdf[j >= floor]
            yield pdf[["a", "b"]]

    side = lambda s: reps.select(F.col("rid").alias(s), F.col("n").alias(f"n{s}"), F.col("regs").alias(f"r{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb").mapInPandas(
        run, "a long, b long")


def _sharable(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(rid, n, s): the set size, and how many of its shingles occur in another component too.

    No two sets of different components share more than the smaller s, so classes and pairs
    that s rules out need no comparison: exact, and linear in the shingles.
    """
    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf["set"].map(len).to_numpy() // 8
            for i in range(0, len(pdf), 256):
                part = slice(i, i + 256)
                yield pd.DataFrame({"rid": np.repeat(pdf["rid"].to_numpy()[part], sizes[part]),
                                    "comp": np.repeat(pdf["comp"].to_numpy()[part], sizes[part]),
                                    "h": np.frombuffer(b"".join(pdf["set"].iloc[part]), np.int64)})

    mine = stage(open_.select("rid", "comp").distinct())
    rows = sets.join(mine, "rid").select("rid", "comp", "set").mapInPandas(shingles, "rid long, comp long, h long")
    crossing = stage(rows.groupBy("h").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"))
                     .filter("c0 <> c1").select("h"))
    shared = rows.join(crossing, "h").groupBy("rid").agg(F.count(F.lit(1)).alias("s"))
    sizes = sets.join(mine, "rid").select("rid", (F.octet_length("set") / 8).cast("long").alias("n"))
    return stage(sizes.join(shared, "rid").select("rid", "n", "s"))


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum())


def _leftover_links(members: DataFrame, able: DataFrame, percent: int, floor: float) -> DataFrame:
    """Links (a, b) inside a bucket between different components, exact, one per member and component.

    ``members``: (band, key, rid, comp) of buckets with several components; ``able``: (rid, n, s,
    regs, set), joined once the blocks are dealt, so sets move once. Every link sought has an end outside the bucket's most frequent component. Those ends ("odd")
    are compared with all members, block against block of at most about BLOCK rows, so a
    bucket of any size splits into bounded groups; members of the main component only meet odd
    ones. Pairs pass what their sets can share, then the likelihood, then the full sets, the
    likeliest first; the first link to a component ends the search there, so what leaves a
    block is linear in its members however many near misses it holds.
    """
    key = ["band", "key"]
    per_comp = members.groupBy(*key, "comp").count()
    main = per_comp.groupBy(*key).agg(F.sum("count").alias("size"), F.max(F.struct("count", "comp")).alias("m"))
    main = stage(main.select(*key, F.col("m.comp").alias("main"), F.ceil(F.col("size") / BLOCK).cast("int").alias("nb"),
                             F.ceil((F.col("size") - F.col("m.count")) / BLOCK).cast("int").alias("no")).filter("no > 0"))
    d = members.join(main, key)
    h = F.xxhash64("rid")
    odd = (d.filter("comp <> main").withColumn("i", F.pmod(h, F.col("no")).cast("int"))
           .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("odd", F.lit(True)))
    rest = (d.withColumn("j", F.pmod(h, F.col("nb")).cast("int"))
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("no") - 1))).withColumn("odd", F.lit(False)))
    cols = [*key, "i", "j", "odd", "rid", "comp", "main"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["odd"]], pdf[~pdf["odd"]]
        a, b = [], []
        if len(x) and len(y):
            ry = np.stack([np.frombuffer(r, ">u2") for r in y["regs"]]).astype(np.uint16)
            yr, yc, yn, ys, ymain = (y[c].to_numpy() for c in ("rid", "comp", "n", "s", "main"))
            sets = [np.frombuffer(v, np.uint64) for v in y["set"]]
            for rid, comp, n, s, reg, own in zip(x["rid"], x["comp"], x["n"], x["s"], x["regs"], x["set"]):
                # a pair of two odd members is met from both sides: take it from the larger id
                most = np.minimum(ys, s)
                at = np.flatnonzero((yc != comp) & ((yc == ymain) | (yr < rid)) & (100 * most >= percent * (yn + n - most)))
                if not len(at):
                    continue
                r = np.frombuffer(reg, ">u2").astype(np.uint16)
                j = jaccard_estimate(np.full(len(at), float(n)), yn[at].astype(float), (r > ry[at]).sum(1),
                                     (r < ry[at]).sum(1), len(r))
                order = np.argsort(-j, kind="stable")
                order = order[j[order] >= floor]
                own, linked = np.frombuffer(own, np.uint64), set()
                for k in at[order].tolist():
                    if yc[k] not in linked:
                        both = _shared(own, sets[k])
                        if 100 * both >= percent * (n + len(sets[k]) - both):
                            linked.add(yc[k])
                            a.append(rid)
                            b.append(yr[k])
        return pd.DataFrame({"a": np.array(a, "int64"), "b": np.array(b, "int64")})

    # much work per row: keep the blocks on all partitions
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(odd.select(*cols).unionAll(rest.select(*cols)))
    return (dealt.join(able, "rid").repartition(parts, *key, "i", "j").groupBy(*key, "i", "j")
            .applyInPandas(run, "a long, b long").distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                percent: int = 75, m: int = M, band: int = BAND) -> DataFrame:
    """One row per input row: id, th (xxhash64 of the text), n_shingles, component_id, kept.

    A-Z is lower-cased, words are runs without white space, and the set is that of the
    distinct ``words``-word shingles (fewer words: the whole sequence as one). Two rows link
    when 100 * shared >= percent * union; components are closed over links. component_id is
    the smallest id of the component; kept is id = component_id. Rows without words have
    n_shingles 0, link with nothing and stand alone. A null id links like others, never names
    a component that has an id, and the first row of a component without ids is the kept one. Repeated rows have
    equal sets and one component. Other columns are ignored; an empty table gives an empty one.

    Equal sets collapse to one class first, so copies cost one row per task. In each bucket
    every class meets the smallest one only (a combined minimum, then a join that adaptive
    execution can split): linear in the bucket. Buckets that still hold several components
    afterwards are compared in bounded blocks, only across components. Nothing is capped;
    candidates are screened by what their sets can share at all and at a similarity of five
    standard errors below the threshold, and then confirmed on the full sets, which are
    rebuilt for the classes that share a bucket.
    """
    floor = percent / 100 - 5.0 * math.sqrt(percent / 100 * (1 - percent / 100) / m)
    rows = sketch(docs, id_col, text_col, words, m)
    reps = stage(rows.filter("n > 0").groupBy("digest", "n").agg(
        F.min(F.struct("rid", "id", "th", "regs")).alias("r")).select("digest", "n", "r.*"))
    bands = reps.select("rid", "n", F.explode(F.sequence(F.lit(0), F.lit(m // band - 1))).alias("band"), "regs").select(
        "rid", "band", F.substring("regs", F.col("band") * 2 * band + 1, F.lit(2 * band)).alias("key"))
    heads = stage(bands.groupBy("band", "key").agg(F.min("rid").alias("head"), F.count(F.lit(1)).alias("size"))
                  .filter("size > 1").select("band", "key", "head"))
    members = stage(bands.join(heads, ["band", "key"]).select("band", "key", "rid", "head"))
    stars = members.filter("rid <> head").select(F.col("head").alias("a"), F.col("rid").alias("b")).distinct()
    first = stage(_screen(stars, reps, floor))

    # full sets of the classes that share a bucket, from their texts
    wanted = members.select("rid").distinct().join(
        reps.select("rid", F.col("id").alias("w_id"), F.col("th").alias("w_th")), "rid")
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    texts = src.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rid": pdf["rid"], "set": [s.tobytes() for s in shingle_hashes(pdf["text"].tolist(), words)]})

    sets = stage(texts.select("rid", "text").mapInPandas(full, "rid long, set binary").dropDuplicates(["rid"]))
    links = _verify(first, sets, percent)
    comp = components(links)
    comp_of = reps.select("rid").join(comp, F.col("rid") == F.col("node"), "left").select(
        "rid", F.coalesce("root", "rid").alias("comp"))
    held = members.select("band", "key", "rid").join(comp_of, "rid")
    mixed = held.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1")
    held = stage(held.join(stage(mixed.select("band", "key")), ["band", "key"]).select("band", "key", "rid", "comp"))
    able = _sharable(held, sets).filter(F.col("s") * 100 >= F.col("n") * percent)
    able = stage(able.join(reps.select("rid", "regs"), "rid").join(sets, "rid"))
    held = stage(held.join(able.select("rid"), "rid"))
    links = links.unionAll(stage(_leftover_links(held, able, percent, floor)))
    comp = components(links)

    root = F.coalesce("root", "rep", "rid")
    found = (rows.select("rid", "id", "th", "digest", "n")
             .join(reps.select("digest", "n", F.col("rid").alias("rep")), ["digest", "n"], "left")
             .join(comp, F.col("rep") == F.col("node"), "left")
             .select("rid", "id", "th", "n", root.alias("root")))
    found = stage(found)
    names = stage(found.groupBy("root").agg(F.min("id").alias("component_id"), F.min("rid").alias("first_rid")))
    return found.join(names, "root").select(
        "id", "th", F.col("n").alias("n_shingles"), "component_id",
        F.when(F.col("component_id").isNull(), F.col("rid") == F.col("first_rid"))
        .otherwise(F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"))
