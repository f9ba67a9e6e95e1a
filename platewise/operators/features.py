"""Featurisation of candidate tables.

Vectors are ``ARRAY<DOUBLE>`` columns built by JVM higher-order functions; sparse
forms are long tables ``(id, key, value)``. Category levels are the only thing
that reaches the driver, and only up to ``max_levels`` per column (a parameter,
checked); beyond it the long form with a level-index join is used.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.functions.rand import md5_u32, md5_unit
from platewise.operators.grams import digest_grams, pack_grams, text_counts
from platewise.session import cut_lineage


# ------------------------------------------------------------------ C1
def category_levels(df: DataFrame, col: str, max_levels: int = 10_000) -> list:
    """Sorted distinct non-null levels of one column (bounded by ``max_levels``, else an error)."""
    lv = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
    if len(lv) > max_levels:
        raise ValueError(f"'{col}' has more than {max_levels} levels; use one_hot_long")
    return sorted(r[0] for r in lv)


def one_hot_array(df: DataFrame, cols: Sequence[str], out_col: str = "features",
                  max_levels: int = 10_000) -> DataFrame:
    """C1 (dense): numeric columns pass through first, then per text column its sorted
    levels as 0/1 dummies; null -> all zeros."""
    parts: list[Column] = []
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    text = [c for c in cols if c not in numeric]
    if numeric:
        parts.append(F.array(*[F.col(c).cast("double") for c in numeric]))
    for c in text:
        levels = category_levels(df, c, max_levels)
        parts.append(F.array(*[F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0))
                               for v in levels]))
    feats = parts[0] if len(parts) == 1 else F.concat(*parts)
    return df.withColumn(out_col, feats)


def one_hot_long(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """C1 (sparse, any cardinality): (id, column, level, dim) for every non-null category.

    The level index is the rank of the level inside its column over the distinct
    (column, level) table, so no list of levels ever reaches the driver.
    """
    long = df.select(id_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("s"))
    long = long.select(id_col, "s.column", "s.level").where(F.col("level").isNotNull())
    from platewise.operators.ordered import global_rank

    # level index = rank inside its column over the distinct (column, level) table, taken
    # from one distributed rank (a very wide column is not held by one task)
    levels = global_rank(long.select("column", "level").distinct(), ["column", "level"])
    starts = levels.groupBy("column").agg(F.min("rank").alias("__r0"))
    levels = levels.join(F.broadcast(starts), "column").select(
        "column", "level", (F.col("rank") - F.col("__r0")).alias("dim"))
    return long.join(levels, ["column", "level"])


# ------------------------------------------------------------------ grams
def normalise_ws(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, r"\s\s+", " ")


def char_grams(col: Column, n_min: int, n_max: int) -> Column:
    """Array of all overlapping character n-grams, n_min <= n <= n_max (spans whitespace
    and newlines). Each length is one native regex scan, ``(?s)(?=(.{n})).``: a look-ahead
    captures the gram at every character (a pair of surrogates is one), so a text costs O(len * n)
    inside the JVM with no per-gram lambda. Texts shorter than n give no n-gram.
    """
    arrays = [F.regexp_extract_all(col, F.lit(f"(?s)(?=(.{{{n}}}))."), 1) for n in range(n_min, n_max + 1)]
    return F.concat(*arrays) if len(arrays) > 1 else arrays[0]


STRETCH = 4096  # characters of a text whose grams are held at a time


def exploded_grams(df: DataFrame, keep: Sequence[str | Column], col: Column, n_min: int, n_max: int, out_col: str = "gram") -> DataFrame:
    """(keep..., gram): one row per overlapping gram of ``char_grams``, stretch by stretch.

    A text is cut into stretches of ``STRETCH`` characters by one regex scan; each carries the
    first n_max - 1 characters of the next, so every gram starts in exactly one stretch and no
    row ever holds more than (n_max - n_min + 1) * STRETCH grams, however long the text is.
    """
    cut = df.select(*keep, F.regexp_extract_all(col, F.lit(f"(?s).{{1,{STRETCH}}}"), 0).alias("__s"))
    names = cut.columns[:-1]
    after = lambda i: F.substring(F.coalesce(F.get(F.col("__s"), i + 1), F.lit("")), 1, max(n_max - 1, 0))
    pieces = cut.select(*names, F.explode(F.transform("__s", lambda s, i: F.struct(s.alias("body"), after(i).alias("next")))).alias("__p"))
    pieces = pieces.select(*names, "__p.body", "__p.next")
    own = [char_grams(F.concat(F.col("body"), F.substring("next", 1, n - 1)) if n > 1 else F.col("body"), n, n)
           for n in range(n_min, n_max + 1)]
    return pieces.select(*names, F.explode(F.concat(*own) if len(own) > 1 else own[0]).alias(out_col))


# ------------------------------------------------------------------ C2
def char_ngrams(df: DataFrame, id_col: str, col: str, max_ngram: int = 5, packed: bool = False) -> DataFrame:
    """Counts of 1..max_ngram character grams (case kept, whitespace runs collapsed),
    long form (id, gram, count).

    A text's grams are counted in its own task, a long text stretch by stretch; counts are
    shuffled only if an id is on several rows, to be added up. ``packed`` gives them as blocks of
    texts with the grams of each block (see ``grams``), which take less room than the counts;
    ``gram_vocabulary`` and ``gram_digest`` read these.
    """
    kind, stretch, raw = df.schema[id_col].dataType.simpleString(), 64 * STRETCH, normalise_ws(col).cast("binary")
    if packed:
        return pack_grams(df, id_col, raw, max_ngram, stretch)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(batch.column(1).to_pylist()):
                if seen := text_counts(_decoded(text), max_ngram, stretch):
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[at], len(seen)), pa.array(seen, pa.string()),
                                                      pa.array(seen.values(), pa.int64())], [id_col, "gram", "count"])

    counts = df.select(id_col, raw).mapInArrow(rows, f"{id_col} {kind}, gram string, count long")
    if df.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").isEmpty():
        return counts
    return counts.groupBy(id_col, "gram").agg(F.sum("count").alias("count"))


def gram_vocabulary(counts: DataFrame) -> DataFrame:
    """Sorted vocabulary with a dense index: the distinct grams are range-partitioned and
    numbered by partition offsets (``global_rank``), JVM-side, so no single task (and not
    the driver) sees the whole vocabulary."""
    from platewise.operators.ordered import global_rank

    distinct = counts.select("gram").filter(F.col("gram").isNotNull()).distinct()
    return global_rank(distinct, ["gram"], out_col="gram_index")


def gram_digest(df: DataFrame, counts: DataFrame, vocabulary: DataFrame, id_col: str, col: str, max_ngram: int = 5) -> DataFrame:
    """One digest row per id with grams, from the packed ``counts`` of ``df``: distinct grams, grams,
    an index-weighted checksum and the largest index (``grams.DIGEST``).

    All but the distinct grams add up over the rows of an id. Where an id is on several rows, its
    grams are told apart from its counts in long form.
    """
    parts = digest_grams(counts, vocabulary, id_col, max_ngram, 64 * STRETCH)
    several = parts.groupBy(id_col).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").select(F.col(id_col).alias("__id"))
    if several.isEmpty():
        return parts
    of_several = df.join(several, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").select(id_col, col)
    told = char_ngrams(of_several, id_col, col, max_ngram).groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__told"))
    sums = parts.groupBy(id_col).agg(F.sum("n_distinct").alias("n_distinct"), F.sum("n_grams").alias("n_grams"),
                                     F.sum("index_checksum").alias("index_checksum"), F.max("max_index").alias("max_index"))
    return sums.join(told, F.col(id_col).eqNullSafe(F.col("__id")), "left").select(
        id_col, F.coalesce("__told", "n_distinct").alias("n_distinct"), "n_grams", "index_checksum", "max_index")


# ------------------------------------------------------------------ C3 / C4
CACHED_GRAMS = 1 << 20  # hashed grams a task remembers


def _distinct_grams(text: str, radius: int) -> set[str]:
    return {text[i:i + n] for n in range(1, radius + 1) for i in range(len(text) - n + 1)}


def _distinct_keys(text: str, radius: int) -> np.ndarray:
    """The grams of ``_distinct_grams`` as numbers, for a radius of up to 3: 21 bits a character, its
    code point plus one."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64) + 1
    key, found = points, []
    for n in range(1, min(radius, len(points)) + 1):
        key = points if n == 1 else key[:-1] << 21 | points[n - 1:]
        found.append(np.unique(key))
    return np.concatenate(found) if found else points


def _spelled(key: int) -> str:
    return (_spelled(key >> 21) if key >> 21 else "") + chr((key & (1 << 21) - 1) - 1)


def _gram_hashes(known: dict[str | int, int], grams: set[str] | np.ndarray) -> np.ndarray:
    """First 8 hex digits of the md5 of every gram, as integers; ``known`` keeps them from text to text."""
    if len(known) > CACHED_GRAMS:
        known.clear()
    keys = grams.tolist() if isinstance(grams, np.ndarray) else list(grams)
    found = list(map(known.get, keys))
    if None in found:
        for at, g in enumerate(keys):
            if found[at] is None:
                raw = (_spelled(g) if isinstance(g, int) else g).encode()
                found[at] = known[g] = int.from_bytes(md5(raw).digest()[:4], "big")
    return np.array(found, np.int64)


def _print_rows(df: DataFrame, id_col: str, texts: Sequence[str], n_bits: int,
                grams_of: Callable[..., Iterator[set[str] | np.ndarray]]) -> DataFrame:
    """(id, __bits) of every row: the sorted positions of the md5 of the grams that ``grams_of``
    draws from the row's texts, set by set. They are hashed in the row's own task, so neither
    grams nor single bits travel."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | int, int] = {}
        for pdf in batches:
            out = []
            for values in zip(*[pdf[c] for c in texts]):
                found = [np.unique(_gram_hashes(known, g) % n_bits) for g in grams_of(*values)]
                out.append(np.unique(np.concatenate(found)).astype(np.int32) if found else np.empty(0, np.int32))
            yield pd.DataFrame({id_col: pdf[id_col], "__bits": out})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *texts).mapInPandas(rows, f"{id_col} {kind}, __bits array<int>")


def _decoded(raw: bytes | None) -> str:
    return "" if raw is None else bytes(raw).decode("utf-8", "replace")


def _with_prints(df: DataFrame, prints: DataFrame, id_col: str, out_col: str) -> DataFrame:
    return df.join(prints, id_col, "left").withColumn(
        out_col, F.coalesce(F.col(out_col), F.array().cast("array<int>")))


def hashed_fingerprint(df: DataFrame, col: str, radius: int = 3, n_bits: int = 2048,
                       out_col: str = "bits", id_col: str = "candidate_id") -> DataFrame:
    """Fixed-length 0/1 print as sorted set bits: shingles of length 1..radius,
    hash = first 8 hex digits of md5, bit = hash mod n_bits.

    Each text's distinct shingles are hashed in its own task, a long text stretch by stretch;
    only prints are shuffled. Rows without grams get an empty print, rows of one id the union
    of theirs.
    """
    step, distinct = 64 * STRETCH, _distinct_keys if radius <= 3 else _distinct_grams

    def stretches(raw: bytes | None) -> Iterator[set[str] | np.ndarray]:
        text = _decoded(raw)
        return (distinct(text[s:s + step + radius - 1], radius) for s in range(0, len(text), step))

    own = _print_rows(df.select(id_col, F.col(col).cast("binary").alias("__t")), id_col, ["__t"], n_bits, stretches)
    prints = own.groupBy(id_col).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("__bits")))).alias(out_col))
    return _with_prints(df, prints, id_col, out_col)


def difference_fingerprint(df: DataFrame, left: str, right: str, radius: int = 3,
                           n_bits: int = 2048, out_col: str = "bits", id_col: str = "candidate_id") -> DataFrame:
    """C4: print of the shingles found on exactly one side of the transformation.

    Both texts come to one row of their id, and the symmetric difference of their shingles is
    taken and hashed there. Rows of one id count together: a side has the shingles of all its
    distinct texts."""
    def one_sided(lefts, rights) -> Iterator[set[str]]:
        a, b = (set().union(*[_distinct_grams(_decoded(t), radius) for t in side]) for side in (lefts, rights))
        yield a ^ b

    sides = df.groupBy(id_col).agg(*[F.transform(F.collect_set(c), lambda t: t.cast("binary")).alias(n)
                                     for c, n in ((left, "__l"), (right, "__r"))])
    prints = _print_rows(sides, id_col, ["__l", "__r"], n_bits, one_sided).withColumnRenamed("__bits", out_col)
    return _with_prints(df, prints, id_col, out_col)


def bits_to_dense(bits: Column | str, n_bits: int) -> Column:
    def dense(batch: pa.Array) -> pa.Array:
        width, at = np.diff(batch.offsets), batch.flatten()  # a null print has no bits, whatever lies under it
        width[np.asarray(batch.is_null())] = 0
        row = np.repeat(np.arange(len(batch)), width)[np.asarray(at.is_valid())]
        at = at.drop_null().to_numpy().astype(np.int64)
        own = (at >= 0) & (at < n_bits)
        out = np.zeros((len(batch), n_bits))
        out[row[own], at[own]] = 1.0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * n_bits, pa.int32()), pa.array(out.ravel()))

    return F.arrow_udf(dense, "array<double>")(F.col(bits) if isinstance(bits, str) else bits)


# ------------------------------------------------------------------ C5
def canonical_key(col: Column | str) -> Column:
    """Canonical form of a lookup key: trimmed, lower case, inner whitespace collapsed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def descriptor_lookup(df: DataFrame, descriptors: DataFrame, key: str, desc_key: str,
                      order_col: str | None = None) -> DataFrame:
    """Attach descriptor columns by canonical key; unmatched rows stay, with nulls.

    Descriptor keys are de-duplicated first (lowest ``order_col``, or smallest row by
    value) so a repeated key can never multiply candidate rows. The join is left
    outer on the normalised key; AQE broadcasts the descriptor side when it is small.
    """
    cols = [c for c in descriptors.columns if c not in (desc_key, order_col)]
    d = descriptors.withColumn("__ck", canonical_key(desc_key))
    order = [F.col(order_col).alias("__ord")] if order_col else []
    firsts = d.groupBy("__ck").agg(F.min(F.struct(*order, *[F.col(c) for c in cols])).alias("__s"))
    firsts = firsts.select("__ck", *[F.col("__s")[c].alias(c) for c in cols])
    return (df.withColumn("__ck", canonical_key(key)).join(firsts, "__ck", "left").drop("__ck"))


# ------------------------------------------------------------------ C6
def concat_features(df: DataFrame, *cols: str, out_col: str = "features") -> DataFrame:
    """Glue vector columns end to end (same row); join first when they live apart."""
    return df.withColumn(out_col, F.concat(*[F.col(c) for c in cols]))


# ------------------------------------------------------------------ C7
# Pattern catalogue (re-aimed fragment / quantum-number counts).
PATTERN_CATALOGUE: dict[str, str] = {
    "digit": "[0-9]",
    "upper": "[A-Z]",
    "lower": "[a-z]",
    "space": " ",
    "newline": "\n",
    "open_paren": "[(]",
    "open_bracket": "\\[",
    "bond_like": "[=#]",
    "ring_digit": "[A-Za-z][0-9]",
    "word": "[A-Za-z]+",
    "number": "[0-9]+",
    "punct": "[.,;:!?]",
    "at_sign": "@",
    "url_like": "https?://",
}


SIMPLE_CLASS = r"\[[A-Za-z0-9 .,;:!?()=#@_/%+*<>\-]+\]"  # of plain ASCII characters and ranges


def _class_members(item: str) -> np.ndarray | None:
    """Which bytes a one-character pattern matches; None where that is not plain to see."""
    if re.fullmatch(r"[A-Za-z0-9 \n@=#,;:!%_/<>-]|\\[\[\](){}.*+?^$|]", item) or re.fullmatch(SIMPLE_CLASS, item):
        return np.array([c < 128 and bool(re.fullmatch(item, chr(c))) for c in range(256)])
    return None


def _byte_counter(pattern: str) -> Callable[[np.ndarray], int] | None:
    """Counts the pattern's matches in a text's UTF-8 bytes: one character class, a run of one, or two
    classes without a common character after one another. None for any other pattern."""
    one = _class_members(pattern)
    if one is not None:
        return lambda own: np.count_nonzero(one[own])
    if pattern.endswith("+") and (run := _class_members(pattern[:-1])) is not None:
        def runs(own: np.ndarray) -> int:
            inside = run[own]
            return np.count_nonzero(inside[1:] > inside[:-1]) + int(inside[:1].any())

        return runs
    two = re.fullmatch(f"({SIMPLE_CLASS})({SIMPLE_CLASS})", pattern)
    a, b = map(_class_members, two.groups()) if two else (None, None)
    if two and not (a & b).any():
        return lambda own: np.count_nonzero(a[own[:-1]] & b[own[1:]])
    return None


def pattern_counts(df: DataFrame, col: str, catalogue: dict[str, str] = PATTERN_CATALOGUE,
                   out_col: str = "counts") -> DataFrame:
    """One integer per catalogue pattern (non-overlapping regex match count).

    Patterns of one or two plain character classes, all but one of ``PATTERN_CATALOGUE``, are counted
    in one pass over the bytes of a text, the others by the JVM's regex engine."""
    counters = {p: f for p in dict.fromkeys(catalogue.values()) if (f := _byte_counter(p))}

    def count(batch: pa.Array) -> pa.Array:
        out = []
        for raw in batch:
            own = np.frombuffer(raw.as_py(), np.uint8) if raw.is_valid else None
            out.append(None if own is None else [int(f(own)) for f in counters.values()])
        return pa.array(out, pa.list_(pa.int32()))

    found = F.arrow_udf(count, "array<int>")(F.col(col).cast("binary"))
    place = {p: k for k, p in enumerate(counters)}
    return df.withColumn(out_col, F.array(*[F.get(found, F.lit(place[p])) if p in place else F.regexp_count(F.col(col), F.lit(p))
                                            for p in catalogue.values()]))


# ------------------------------------------------------------------ C8
def random_features(df: DataFrame, id_col: str, d: int, kind: str = "continuous", seed: int = 0,
                    out_col: str = "features") -> DataFrame:
    """Reproducible random vector per row: md5(seed:id:dim) / 2^32, or its bit (>= 0.5)."""
    if kind not in ("continuous", "bits"):
        raise ValueError("kind must be 'continuous' or 'bits'")

    def val(i: Column) -> Column:
        u = md5_unit(F.lit(str(seed)), F.col(id_col), i)
        return u if kind == "continuous" else F.when(u >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))

    return df.withColumn(out_col, F.transform(F.sequence(F.lit(0), F.lit(d - 1)), val))


# ------------------------------------------------------------------ C9
def tokens(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0)


POOL_WIDTH = 64  # coordinates of a vector summed in one row
POOL_BROADCAST = 20_000  # token vectors sent to every task


def sum_pool_tokens(df: DataFrame, id_col: str, text_col: str, vectors: DataFrame,
                    token_col: str = "token", vec_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Text vector = sum of its token vectors; unknown tokens are dropped and counted.

    A vector stays one row (``POOL_WIDTH`` coordinates of it, if it is longer) through join and
    sum. A counted small vocabulary is broadcast, so the tokens of a text meet it where they are
    and only one sum per text is shuffled. Beyond, tokens are counted per (text, token) first and
    joined once per text, their vectors scaled by the count. The sums are written once; both
    results read them.
    """
    table = cut_lineage(vectors.select(token_col, vec_col))
    rows, longest = table.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    width = min(POOL_WIDTH, max(longest or 1, 1))
    starts = F.sequence(F.lit(1), F.greatest(F.size(vec_col), F.lit(1)), F.lit(width))
    chunks = F.when(F.col(vec_col).isNotNull(), F.transform(starts, lambda s: F.slice(vec_col, s, width)))
    # the small table is cut once, before the join: a row of it copied per token stays one array
    table = cut_lineage(table.select(token_col, F.posexplode_outer(chunks).alias("__c", "__v")))
    key = [id_col] if (longest or 0) <= width else [id_col, "__c"]
    found = df.select(id_col, F.explode(tokens(text_col)).alias(token_col))
    if rows <= POOL_BROADCAST:
        j = found.withColumn("__n", F.lit(1).cast("bigint")).join(F.broadcast(table), token_col, "left")
    else:
        j = found.groupBy(id_col, token_col).agg(F.count(F.lit(1)).alias("__n")).join(table, token_col, "left")
    sums = cut_lineage(j.groupBy(*key).agg(
        F.max(F.when(F.col("__v").isNotNull(), F.size("__v"))).alias("__size"),
        F.sum(F.when(F.col("__v").isNull(), F.col("__n")).otherwise(0)).alias("__u"),
        F.array(*[F.sum(F.get("__v", F.lit(k)) * F.col("__n")) for k in range(width)]).alias("__s")))
    first = F.lit(0) if key == [id_col] else F.col("__c") * F.lit(width)
    pooled = sums.filter(F.col("__size").isNotNull()).select(
        id_col, first.alias("__first"), F.posexplode(F.slice("__s", F.lit(1), F.col("__size"))).alias("__k", "value"))
    unknown = sums.groupBy(id_col).agg(F.sum("__u").alias("unknown_tokens"))
    return pooled.select(id_col, (F.col("__first") + F.col("__k")).alias("dim"), "value"), unknown


# ------------------------------------------------------------------ C13
def _fp(df, col, bond_radius=3, n_bits=2048, id_col="candidate_id", **_):
    return hashed_fingerprint(df, col, bond_radius, n_bits, out_col="features_bits", id_col=id_col)


def _fp_dense(df, col, n_bits=2048, **kw):
    return _fp(df, col, n_bits=n_bits, **kw).withColumn("features", bits_to_dense("features_bits", n_bits)).drop("features_bits")


def _drfp(df, col, bond_radius=3, n_bits=2048, id_col="candidate_id", rxn_cols=None, **_):
    if not rxn_cols:
        raise ValueError("'drfp' needs the two reaction columns")
    return difference_fingerprint(df, rxn_cols[0], rxn_cols[1], bond_radius, n_bits, out_col="features_bits", id_col=id_col)


def _drfp_dense(df, col, n_bits=2048, **kw):
    return _drfp(df, col, n_bits=n_bits, **kw).withColumn("features", bits_to_dense("features_bits", n_bits)).drop("features_bits")


def _bag(df, col, max_ngram=5, **_):
    return df.withColumn("features_grams", char_grams(normalise_ws(col), 1, max_ngram))


def _patterns(df, col, **_):
    return pattern_counts(df, col, out_col="features_counts")


def _patterns_dense(df, col, **_):
    return pattern_counts(df, col, out_col="features").withColumn("features", F.col("features").cast("array<double>"))


def _one_hot(df, col, columns=None, **_):
    return one_hot_array(df, list(columns or [col]))


def _random(df, col, dims=64, seed=0, id_col="candidate_id", kind="continuous", **_):
    return random_features(df, id_col, dims, kind, seed)


def _random_bits(df, col, **kw):
    return _random(df, col, kind="bits", **kw)


def _descriptors(df, col, lookup=None, key_col="key", value_cols=None, **_):
    if lookup is None:
        raise ValueError("'descriptors' needs a lookup table")
    value_cols = list(value_cols or [c for c in lookup.columns if c != key_col])
    found = descriptor_lookup(df, lookup.select(key_col, *value_cols), col, key_col)
    return found.withColumn("features", F.array(*[F.col(c).cast("double") for c in value_cols])).drop(*value_cols)


def _sum_pool(df, col, vectors=None, id_col="candidate_id", **_):
    if vectors is None:
        raise ValueError("'sum_pool' needs a token vector table")
    pooled, _ = sum_pool_tokens(df, id_col, col, vectors)
    rows = pooled.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("__p"))
    return df.join(rows, id_col, "left").withColumn("features", F.transform("__p", lambda x: x["value"])).drop("__p")


#: Representations that read the molecule column, and the one that reads both reaction sides.
REPRESENTATIONS: dict[str, Callable[..., DataFrame]] = {
    "fingerprints": _fp,
    "bag_of_characters": _bag,
    "fragments": _patterns,
    "one_hot": _one_hot,
    "random": _random,
    "random_bits": _random_bits,
    "descriptors": _descriptors,
    "sum_pool": _sum_pool,
}
REACTION_REPRESENTATIONS = {"drfp": _drfp}
#: Forms with one number per coordinate, which can be glued together as "a+b".
DENSE: dict[str, Callable[..., DataFrame]] = {
    "fingerprints": _fp_dense, "fragments": _patterns_dense, "one_hot": _one_hot, "random": _random,
    "random_bits": _random_bits, "descriptors": _descriptors, "sum_pool": _sum_pool, "drfp": _drfp_dense,
}


def featurize(df: DataFrame, representation: str, mol_col: str = "text", rxn_cols: tuple[str, str] | None = None,
              bond_radius: int = 3, n_bits: int = 2048, max_ngram: int = 5, id_col: str = "candidate_id",
              **options) -> DataFrame:
    """Pick a representation by name; unknown names raise, listing the valid ones.
    Reaction representations read the two reaction sides, the others the molecule column.

    ``"a+b"`` glues the dense forms of several into one ``features`` vector, in the order named.
    ``options`` reach the representation: columns (one_hot), dims and seed (random), lookup,
    key_col and value_cols (descriptors), vectors (sum_pool).
    """
    names = [n.strip() for n in representation.split("+")]
    table = DENSE if len(names) > 1 else REPRESENTATIONS | REACTION_REPRESENTATIONS
    for n in names:
        if n not in table:
            raise ValueError(f"unknown representation '{n}'; choose one of {sorted(table)}")
    opts = dict(options, bond_radius=bond_radius, n_bits=n_bits, max_ngram=max_ngram, id_col=id_col, rxn_cols=rxn_cols)
    if len(names) == 1:
        return table[names[0]](df, mol_col, **opts)
    out, parts = df, []
    for i, n in enumerate(names):
        out = table[n](out, mol_col, **opts).withColumnRenamed("features", f"__part{i}")
        parts.append(f"__part{i}")
    return concat_features(out, *parts).drop(*parts)
