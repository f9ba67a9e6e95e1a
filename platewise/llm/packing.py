"""Mixture-controlled packing of documents into token sequences.

Deficit round-robin over one queue per source: in every window a source's deficit grows by
its share of the window's tokens, and its documents leave the queue as soon as the deficit
covers them; what is left over is carried into the next window. With cumulative token counts
this has a closed form, so no window waits for another: a document leaves in the first
window by whose end its source has been granted as many tokens as the queue holds up to the
document's end. The windows' documents, source after source, form one stream that is cut
into sequences. Prefix sums carry both across partitions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import stage

END_ID = 1
LENGTH = 2048
CACHE = 400_000  # words whose ids a worker remembers
_LOOSE = re.compile(r" (?:\s|\Z)")


class Bpe:
    """Ids of a byte-level BPE given as a ``tokenizers`` file and as the same vocabulary's ranks.

    Text whose every space precedes a non-space falls into words that the pre-tokenizer
    never joins, so each distinct word is encoded once and remembered. Other text is encoded
    as a whole, and text that holds a special token's string by the ``tokenizers`` file.
    """

    def __init__(self, json_path: str, ranks_path: str) -> None:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.dtype = "<u2" if max(self.full.get_vocab_size(), max(ranks.values()) + 1) < 1 << 16 else "<u4"
        self.words: dict[str, bytes] = {}

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._raw(self.full.encode(text, add_special_tokens=False).ids)
        if _LOOSE.search(text):
            return self._raw(self.fast.encode_ordinary(text))
        words = text.split(" ")
        out = [self._raw(self.fast.encode_ordinary(words[0]))]
        known = self.words
        out += map(known.get, words[1:])
        if None in out:
            if len(known) > CACHE:
                known.clear()
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    x = known.get(w)
                    if x is None:
                        x = known[w] = self._raw(self.fast.encode_ordinary(" " + w))
                    out[i] = x
        return b"".join(out)


@lru_cache(maxsize=2)
def _bpe(json_path: str, ranks_path: str) -> Bpe:
    return Bpe(json_path, ranks_path)


def running_sum(df: DataFrame, group: str, order: list[str], weight: str, out: str) -> DataFrame:
    """Exclusive running sum of ``weight`` per ``group`` along ``order``, staged layout.

    Rows are range-partitioned on (group, order), so a hot group spreads over many partitions;
    sums inside a partition are windows of (partition, group), and only one row per such pair
    crosses partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = (df.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
            .withColumn("_mid", F.monotonically_increasing_id()))
    laid = stage(laid).withColumn("_pid", F.shiftright("_mid", 33))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("_pid", group).agg(F.sum(weight).alias("_w"))
    parts = stage(parts.select("_pid", group, F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_off")))
    inner = Window.partitionBy("_pid", group).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    return (laid.join(parts, ["_pid", group])
            .withColumn(out, F.col("_off") + F.coalesce(F.sum(weight).over(inner), F.lit(0))).drop("_mid", "_pid", "_off"))


def tail_cuts(total: int, length: int) -> list[int]:
    """Positions where the last, short stretch of the stream is cut: into powers of two."""
    at, rest, cuts = total - total % length, total % length, []
    while rest:
        at += 1 << (rest.bit_length() - 1)
        rest -= 1 << (rest.bit_length() - 1)
        cuts.append(at)
    return cuts


def pack(docs: DataFrame, tokenizer: str, ranks: str, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", length: int = LENGTH, end_id: int = END_ID, window: int = 64 * LENGTH,
         weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of documents in sequences: id, source, start, length, ids (little-endian unsigned
    32-bit), doc_tokens, sequence_id, offset, window.

    A document is its text's ids (null text: none) and ``end_id``. Every token lies in one
    piece. Sequences hold ``length`` tokens each; the rest of the stream is cut into powers
    of two, so nothing is padded. Windows of ``window`` tokens are filled by deficit
    round-robin: each source is granted ``window`` times its share, by ``weights`` (sources
    without one: 0 until the others are through) or by default its share of all tokens. A null
    source is a queue of its own; repeated rows and null ids are separate documents; other
    columns are ignored; an empty table gives an empty one. Queues are ordered by a hash of
    the id, then by row.

    The text becomes ids once, staged; plans move only (row, count) rows.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(tokenizer, ranks)
        end = np.array([end_id], bpe.dtype).tobytes()
        for pdf in batches:
            raw = [(bpe.encode(t) if t else b"") + end for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "source": pdf["source"], "raw": raw,
                                "n": [len(r) // int(bpe.dtype[2]) for r in raw]})

    # ids travel as text: pandas would turn integers beside a null into floats
    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    coded = stage(src.mapInPandas(encode, "id string, source string, raw binary, n long")
                  .withColumn("rid", F.monotonically_increasing_id()))
    queue = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("-"))
    d = coded.select("rid", "n", queue.alias("queue"), F.xxhash64("id").alias("h"))
    totals = d.groupBy("queue").agg(F.sum("n").alias("tokens"))
    if weights is None:
        grant = F.col("tokens").cast("double")
    else:
        grant = F.lit(0.0)
        for k, v in weights.items():
            grant = F.when(F.col("queue") == "s" + k, F.lit(float(v))).otherwise(grant)
    totals = stage(totals.withColumn("grant", grant))
    sums = totals.agg(F.sum("tokens").alias("t"), F.sum("grant").alias("g")).first()
    total, granted = sums["t"] or 0, sums["g"] or 0.0
    quantum = F.col("grant") * F.lit(window / granted if granted else 0.0)
    totals = totals.select("queue", quantum.alias("quantum"))

    queued = running_sum(d, "queue", ["h", "rid"], "n", "before")
    # a queue without a grant comes after every window that others can fill
    last = F.when(F.col("quantum") > 0, F.floor((F.col("before") + F.col("n") - 1) / F.col("quantum"))).otherwise(
        F.lit(1 << 40) + F.floor(F.col("before") / window))
    windowed = queued.join(totals, "queue").select("rid", "n", "queue", "before", last.cast("long").alias("window"))
    placed = running_sum(windowed.withColumn("all", F.lit(0)), "all", ["window", "queue", "before"], "n", "pos")
    cuts = np.array(tail_cuts(total, length), np.int64)
    whole = total - total % length

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for id_, source, raw, n, pos, win in zip(pdf["id"], pdf["source"], pdf["raw"], pdf["n"], pdf["pos"], pdf["window"]):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                at = pos
                while at < pos + n:
                    if at < whole:
                        seq, head = at // length, at // length * length
                        stop = head + length
                    else:
                        k = int(np.searchsorted(cuts, at, "right"))
                        seq, head, stop = whole // length + k, int(cuts[k - 1]) if k else whole, int(cuts[k])
                    stop = min(stop, pos + n)
                    out.append((id_, source, at - pos, stop - at, ids[at - pos:stop - pos].tobytes(), n, seq, at - head, win))
                    at = stop
                if len(out) >= 4096:
                    yield pd.DataFrame(out, columns=cols)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=cols)

    cols = ["id", "source", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window"]
    pieces = coded.join(placed.select("rid", "pos", "window"), "rid").select(
        "id", "source", "raw", "n", "pos", "window").mapInPandas(
        cut, "id string, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, "
             "offset long, window long")
    return pieces.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
