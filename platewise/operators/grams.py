"""Character grams counted block by block.

A corpus has many more (text, gram) pairs than distinct grams, so pairs are neither written nor
sent. Texts are packed, compressed, into blocks of consecutive texts of a task; a block lists each
of its grams once. Only those lists meet the vocabulary, and what comes back to the block, one
index per gram of the list, is looked up for every text of the block, whose grams are counted there.

Within a block a gram is a number: the codes of its characters side by side. A block's alphabet
is what fits (4,095 characters for grams of up to five); a text with more is a block of its own.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.session import rewrite, settings

CHUNK = 1 << 16  # characters of the texts in one row, beyond one text
BLOCK_GRAMS = 1 << 20  # distinct grams of a block, beyond the last chunk's
BLOCK_BYTES = 1 << 25  # of its compressed texts
PENDING = 1 << 22  # grams that wait to be merged into a block's list
GRAM_ROWS = 1 << 16  # grams of a list in one batch
BATCH_ROWS = 1024  # rows of packed texts sent to Python at a time
#: ``at`` is twice the block's number for its grams, and one more for its texts.
PACKED = "at long, key long, gram string, ids array<{}>, sizes array<int>, symbols string, texts binary"
DIGEST = ["n_distinct", "n_grams", "index_checksum", "max_index"]


def text_counts(text: str, max_ngram: int, stretch: int) -> Counter:
    """Counts of a text's grams of 1 to ``max_ngram`` characters, a long text's stretch by stretch."""
    seen = Counter()
    for n in range(1, max_ngram + 1):
        for s in range(0, len(text) - n + 1, stretch):
            seen.update(map("".join, zip(*[text[s + k:s + k + stretch] for k in range(n)])))
    return seen


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _bits(max_ngram: int) -> int:
    return min(60 // max_ngram, 21)


def _keys(codes: np.ndarray, sizes: np.ndarray, max_ngram: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every length n, the number of the gram at every character, and whether it ends within its text."""
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
    bits, key, out = _bits(max_ngram), np.zeros(len(codes), np.int64), []
    for n in range(min(max_ngram, len(codes))):
        key = key[:len(codes) - n] | codes[n:] << bits * (max_ngram - 1 - n)
        out.append((key, room[:len(key)] > n))
    return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.flatnonzero(np.diff(keys, prepend=-1))]


def _strings(points: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Strings of ``sizes`` characters each, from all their code points one after the other."""
    raw = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw))


class _Block:
    """Texts taken so far, chunk by chunk, and their distinct grams."""

    def __init__(self, schema: pa.Schema, max_ngram: int, stretch: int, limits: tuple[int, ...]):
        self.schema, self.max_ngram, self.stretch = schema, max_ngram, stretch
        self.most_grams, self.most_bytes, self.most_pending, self.gram_rows = limits
        self.number = TaskContext.get().partitionId() << 31
        self.codes = np.zeros(0x110000, np.int64)
        self.clear()

    def clear(self) -> None:
        self.codes[:] = 0
        self.symbols: list[np.ndarray] = []
        self.n_symbols = self.n_bytes = self.n_pending = 0
        self.keys = np.zeros(0, np.int64)
        self.pending: list[np.ndarray] = []
        self.chunks: list[tuple[pa.Array, np.ndarray, bytes]] = []

    def fits(self, points: np.ndarray) -> bool:
        """Gives the characters codes if the alphabet has room for them."""
        new = np.unique(points[self.codes[points] == 0])
        if self.n_symbols + len(new) >= 1 << _bits(self.max_ngram):
            return False
        self.codes[new] = np.arange(self.n_symbols + 1, self.n_symbols + len(new) + 1)
        self.symbols.append(new)
        self.n_symbols += len(new)
        return True

    def add(self, ids: pa.Array, texts: list[str]) -> Iterator[pa.RecordBatch]:
        whole = "".join(texts)
        points, sizes = _points(whole), np.array([len(t) for t in texts], np.int32)
        if not self.fits(points):
            if len(texts) > 1:
                for k, t in enumerate(texts):
                    yield from self.add(ids[k:k + 1], [t])
                return
            yield from self.close()
            if not self.fits(points):
                yield from self.alone(ids, whole)
                return
        found = _distinct(np.concatenate([key[own] for key, own in _keys(self.codes[points], sizes, self.max_ngram)]))
        self.chunks.append((ids, sizes, zlib.compress(whole.encode(), 1)))
        self.pending.append(found)
        self.n_pending += len(found)
        self.n_bytes += len(self.chunks[-1][2])
        if self.n_pending > self.most_pending:
            self.merge()
        if len(self.keys) > self.most_grams or self.n_bytes > self.most_bytes:
            yield from self.close()

    def merge(self) -> None:
        self.keys, self.pending, self.n_pending = _distinct(np.concatenate([self.keys, *self.pending])), [], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.chunks:
            self.merge()
            symbols = np.concatenate([[0], *self.symbols]).astype(np.uint32)
            bits = _bits(self.max_ngram)
            for s in range(0, len(self.keys), self.gram_rows):
                keys = self.keys[s:s + self.gram_rows]
                codes = np.stack([keys >> bits * (self.max_ngram - 1 - n) & (1 << bits) - 1 for n in range(self.max_ngram)], 1)
                yield self.rows(0, key=pa.array(keys), gram=_strings(symbols[codes[codes > 0]], (codes > 0).sum(1)))
            alphabet = symbols[1:].astype("<u4").tobytes().decode("utf-32-le")
            for ids, sizes, raw in self.chunks:
                yield self.text(ids, sizes, alphabet, raw)
            self.number += 1
        self.clear()

    def alone(self, ids: pa.Array, text: str) -> Iterator[pa.RecordBatch]:
        grams = sorted(text_counts(text, self.max_ngram, self.stretch))
        for s in range(0, len(grams), self.gram_rows):
            part = grams[s:s + self.gram_rows]
            yield self.rows(0, key=pa.array(range(s, s + len(part)), pa.int64()), gram=pa.array(part, pa.string()))
        yield self.text(ids, [len(text)], None, zlib.compress(text.encode(), 1))
        self.number += 1

    def text(self, ids: pa.Array, sizes: np.ndarray, symbols: str | None, raw: bytes) -> pa.RecordBatch:
        column = lambda v, kind: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v, type=kind)
        return self.rows(1, ids=column(ids, self.schema.field("ids").type), symbols=pa.array([symbols], pa.string()),
                         sizes=column(pa.array(sizes, pa.int32()), self.schema.field("sizes").type), texts=pa.array([raw], pa.binary()))

    def rows(self, kind: int, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["at"] = pa.repeat(pa.scalar(2 * self.number + kind, pa.int64()), n)
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in self.schema], schema=self.schema)


def pack_grams(df: DataFrame, id_col: str, raw: Column, max_ngram: int, stretch: int) -> DataFrame:
    """Blocks of the texts ``raw`` (binary), see ``PACKED``. Texts without grams are left out."""
    chunk, limits = CHUNK, (BLOCK_GRAMS, BLOCK_BYTES, PENDING, GRAM_ROWS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for batch in batches:
            if block is None:
                ids = pa.list_(pa.field("element", batch.schema.field(0).type))
                block = _Block(pa.schema([("at", pa.int64()), ("key", pa.int64()), ("gram", pa.string()), ("ids", ids),
                                          ("sizes", pa.list_(pa.field("element", pa.int32()))), ("symbols", pa.string()),
                                          ("texts", pa.binary())]), max_ngram, stretch, limits)
            texts = ["" if t is None else bytes(t).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            some, held = [], 0
            for k, t in enumerate(texts):
                if t:
                    some.append(k)
                    held += len(t)
                if some and (held >= chunk or k + 1 == len(texts)):
                    yield from block.add(batch.column(0).take(pa.array(some)), [texts[s] for s in some])
                    some, held = [], 0
        if block is not None:
            yield from block.close()

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, raw).mapInArrow(pack, PACKED.format(kind))


def digest_grams(packed: DataFrame, vocabulary: DataFrame, id_col: str, max_ngram: int, stretch: int) -> DataFrame:
    """(id, ``DIGEST``) of every text of ``packed``: how many distinct grams and grams it has, the sum of
    the grams' indices in ``vocabulary`` (gram, gram_index), each as often as it occurs, and the largest."""
    def of(found: np.ndarray, counts: np.ndarray) -> tuple[int, ...]:
        return len(found), int(counts.sum()), int((found * counts).sum()), int(found.max())

    def one_block(keys: np.ndarray, index: np.ndarray, sizes: np.ndarray, symbols: str | None, raw: bytes) -> list[tuple[int, ...]]:
        text = zlib.decompress(raw).decode()
        if symbols is None:
            counts = text_counts(text, max_ngram, stretch)
            return [of(index, np.array([counts[g] for g in sorted(counts)], np.int64))]
        known = _points(symbols)
        order = np.argsort(known)
        codes = order[np.searchsorted(known[order], _points(text))].astype(np.int64) + 1
        at = [key for key, _ in _keys(codes, sizes, max_ngram)]
        out = []
        for e, size in zip(np.cumsum(sizes), sizes):
            own = np.sort(np.concatenate([key[e - size:e - n] for n, key in enumerate(at[:size])]))
            starts = np.flatnonzero(np.diff(own, prepend=-1))
            out.append(of(index[np.searchsorted(keys, own[starts])], np.diff(starts, append=len(own))))
        return out

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists, known = None, [], None
        for batch in batches:
            at = batch.column("at").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for s, e in zip(cuts, cuts[1:]):
                part = batch.slice(s, e - s)
                if e > s and at[s] >> 1 != block:
                    block, lists, known = at[s] >> 1, [], None
                if e > s and at[s] & 1 == 0:
                    lists.append((part.column("key").to_numpy(), part.column("gram_index").to_numpy()))
                    continue
                if known is None and lists:
                    keys, index = (np.concatenate(x) for x in zip(*lists))
                    order = np.argsort(keys)
                    known, lists = (keys[order], index[order]), []
                for k in range(e - s):
                    sizes = part.column("sizes")[k].values.to_numpy()
                    rows = one_block(*known, sizes, part.column("symbols")[k].as_py(), part.column("texts")[k].as_py())
                    yield pa.RecordBatch.from_arrays([part.column("ids")[k].values, *[pa.array(c, pa.int64()) for c in zip(*rows)]],
                                                     [id_col, *DIGEST])

    kind = dict(packed.dtypes)["ids"][len("array<"):-1]
    blocks = sorted(r[0] for r in packed.select(F.shiftright("at", 1).alias("b")).distinct().collect())
    numbers = packed.sparkSession.createDataFrame([*enumerate(blocks)], "__p int, __b long")  # one row a block
    lists = packed.filter(F.col("gram").isNotNull()).select("at", "key", "gram").join(vocabulary.hint("shuffle_hash"), "gram")
    met = lists.drop("gram").unionByName(packed.filter(F.col("gram").isNull()).drop("key", "gram"), allowMissingColumns=True)
    met = met.join(F.broadcast(numbers), F.shiftright("at", 1) == F.col("__b")).drop("__b")
    met = met.repartitionById(max(len(blocks), 1), "__p").sortWithinPartitions("at").drop("__p")
    # rows of texts are large: few to a batch
    with settings(packed.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        return rewrite(met.mapInArrow(digest, ", ".join([f"{id_col} {kind}", *[f"{c} long" for c in DIGEST]])))
