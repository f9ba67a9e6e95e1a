"""Reproducible randomness that Spark and SQL engines compute identically.

A row's base draw is the first 8 hex digits of ``md5(seed:key)`` as an unsigned
32-bit integer; further draws per replicate mix that integer with the replicate
number using 32-bit multiply/xor/shift steps whose products stay below 2^63, so
plain BIGINT arithmetic gives the same bits everywhere. No global sort and no
per-row Python are needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296
# Odd multipliers below 2^31 for the 32-bit mixing steps.
MIX_A = 0x7FEB352D
MIX_B = 0x5BD1E995
MIX_R = 0x2545F491


def md5_u32(*parts: Column | str) -> Column:
    """Unsigned 32-bit integer from md5 of the ':'-joined parts."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    h = F.md5(F.concat_ws(":", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def md5_unit(*parts: Column | str) -> Column:
    """Uniform [0, 1) from md5 of the ':'-joined parts."""
    return md5_u32(*parts) / F.lit(float(TWO32))


def _xs(x: Column, k: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, k))


def mix_u32(h: Column, r: Column) -> Column:
    """32-bit mix of a base draw ``h`` and a replicate number ``r``.

    Every intermediate is non-negative and below 2^63, so ``mod 2^32`` is a mask.
    """
    mask = F.lit(TWO32 - 1)
    x = h.bitwiseXOR((r.cast("bigint") * F.lit(MIX_R)).bitwiseAND(mask))
    x = (_xs(x, 16) * F.lit(MIX_A)).bitwiseAND(mask)
    x = (_xs(x, 15) * F.lit(MIX_B)).bitwiseAND(mask)
    return _xs(x, 16)


def np_mix_u32(h, r):
    """``mix_u32`` of int64 numpy arrays, used inside Arrow batches."""
    x = h ^ ((r * MIX_R) & (TWO32 - 1))
    x = ((x ^ (x >> 16)) * MIX_A) & (TWO32 - 1)
    x = ((x ^ (x >> 15)) * MIX_B) & (TWO32 - 1)
    return x ^ (x >> 16)


# ---- SQL twins (DuckDB) -------------------------------------------------
def sql_md5_u32(expr_sql: str) -> str:
    return f"(('0x' || substr(md5({expr_sql}), 1, 8))::BIGINT)"


def sql_mix_u32(h: str, r: str) -> str:
    x = f"xor({h}, ({r}::BIGINT * {MIX_R}) % {TWO32})"
    x = f"((xor({x}, ({x}) >> 16) * {MIX_A}) % {TWO32})"
    x = f"((xor({x}, ({x}) >> 15) * {MIX_B}) % {TWO32})"
    return f"xor({x}, ({x}) >> 16)"
