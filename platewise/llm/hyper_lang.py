"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram binds its letters' vectors
(product), each permuted by its place; a text bundles (sums) its n-grams. A language's
prototype is the bundle of its labelled texts, and a text takes the language whose
prototype has the highest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS = 1024  # components of a vector
GRAM = 3  # letters bound together
SLOTS = 64  # letter vectors: the gap between words, a to z, the other letters by code point
CHUNK = 1 << 20  # characters in work at once
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _slots() -> np.ndarray:
    """Slot of every code point: 0 for what is not a letter."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 4294967296 % (SLOTS - 27)
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The letter vectors, one permuted copy (rotation) per place in an n-gram."""
    base = np.random.RandomState(20240229).randint(0, 2, (SLOTS, DIMS)).astype(np.int8) * 2 - 1
    return np.stack([np.roll(base, GRAM - 1 - k, axis=1) for k in range(GRAM)])


def gram_vectors(codes: np.ndarray) -> np.ndarray:
    """The bound vectors of n-gram codes (base SLOTS, first letter highest)."""
    table, out = _letters(), np.ones((len(codes), DIMS), np.int8)
    for k in range(GRAM):
        out *= table[k][codes // SLOTS ** (GRAM - 1 - k) % SLOTS]
    return out


def gram_counts(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For stretches of texts: (first, last + 1, codes present, counts by text and code)."""
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b] or "") <= CHUNK) and b - a < 256:
            held += len(texts[b] or "")
            b += 1
        parts, lens = [], []
        for t in texts[a:b]:
            padded = f" {t or ''} "
            sym = np.concatenate([_slots()[np.frombuffer(padded[i:i + CHUNK].encode("utf-32-le", "surrogatepass"), np.uint32)]
                                  for i in range(0, len(padded), CHUNK)])
            sym = sym[(sym != 0) | (np.append(1, sym[:-1]) != 0)]  # one gap between words
            parts.append(sym)
            lens.append(len(sym))
        sym, doc = np.concatenate(parts), np.repeat(np.arange(b - a), lens)
        total, codes = None, None
        for i in range(0, max(1, len(sym) - GRAM + 1), 4 * CHUNK):  # more than one round only for one very long text
            s, d = sym[i:i + 4 * CHUNK + GRAM - 1].astype(np.int32), doc[i:i + 4 * CHUNK + GRAM - 1]
            n = len(s) - GRAM + 1
            if n < 1:
                break
            code = np.zeros(n, np.int32)
            for k in range(GRAM):
                code = code * SLOTS + s[k:k + n]
            inside = d[:n] == d[GRAM - 1:]
            code, d = code[inside], d[:n][inside]
            if b - a == 1:
                got = np.bincount(code, minlength=SLOTS**GRAM)
                total = got if total is None else total + got
            else:
                codes = np.flatnonzero(np.bincount(code, minlength=SLOTS**GRAM))
                place = np.zeros(SLOTS**GRAM, np.int32)
                place[codes] = np.arange(len(codes))
                total = np.bincount(d * len(codes) + place[code], minlength=(b - a) * len(codes)).reshape(b - a, -1)
        if total is None:
            codes, total = np.zeros(0, np.int64), np.zeros((b - a, 0), np.int64)
        elif codes is None:
            codes = np.flatnonzero(total)
            total = total[codes][None]
        yield a, b, codes, total
        a = b


def learn_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """The bundle of every language's labelled texts, over all rows of ``docs``.

    Rows without a language are left out; null or letterless text adds nothing. What reaches
    the driver is one vector of DIMS numbers per language.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}
        for pdf in batches:
            langs = pdf["lang"].to_numpy()
            for a, b, codes, counts in gram_counts(pdf["text"].tolist()):
                for lang in set(langs[a:b]):
                    acc = held.setdefault(lang, np.zeros(SLOTS**GRAM, np.int64))
                    acc[codes] += counts[langs[a:b] == lang].sum(0)
        for lang, acc in held.items():
            codes = np.flatnonzero(acc)
            vec = np.zeros(DIMS, np.int64)
            for i in range(0, len(codes), 4096):
                some = codes[i:i + 4096]
                vec += acc[some] @ gram_vectors(some).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMS), "value": vec})

    src = docs.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = (src.mapInPandas(run, "lang string, dim int, value long")
            .groupBy("lang", "dim").agg(F.sum("value").alias("value")).toPandas())
    return {k: g.sort_values("dim")["value"].to_numpy(np.float64) for k, g in rows.groupby("lang")}


def language(text: Column, prototypes: dict[str, np.ndarray]) -> Column:
    """struct(lang_pred, score): the closest prototype and its cosine, cut to 0 .. 1.

    ``und`` with score 0 for a null text, a text without letters, or without any prototype.
    """
    names = sorted(k for k, v in prototypes.items() if np.abs(v).sum() > 0)
    protos = np.stack([prototypes[k] / np.linalg.norm(prototypes[k]) for k in names]) if names else np.zeros((0, DIMS))
    protos = protos.astype(np.float32)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        pred, score = [], []
        for a, b, codes, counts in gram_counts(texts.tolist()):
            vec = counts.astype(np.float32) @ gram_vectors(codes).astype(np.float32)
            norm = np.linalg.norm(vec, axis=1)
            cos = vec @ protos.T / np.where(norm > 0, norm, 1.0)[:, None]
            # a text without letters has no n-gram with one: only gaps
            lettered = counts[:, codes > 0].sum(1) > 0
            for i in range(b - a):
                if lettered[i] and names:
                    k = int(cos[i].argmax())
                    pred.append(names[k])
                    score.append(min(1.0, max(0.0, float(cos[i, k]))))
                else:
                    pred.append(UNKNOWN)
                    score.append(0.0)
        return pd.DataFrame({"lang_pred": pred, "score": score})

    return run(text)


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added (columns of those names are replaced).

    One narrow pass over whole texts; repeated rows and extra columns pass through, an empty
    table stays empty.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(*[F.col(f"`{c}`") for c in kept], language(F.col(text_col), prototypes).alias("_found"))
    return out.select(*[F.col(f"`{c}`") for c in kept], "_found.lang_pred", "_found.score")
