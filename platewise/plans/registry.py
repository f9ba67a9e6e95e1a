"""Query catalogue: every key has a Spark builder and, where SQL can say it, a DuckDB oracle.

Conventions shared by both sides (so the driver's comparison is exact):
doubles are rounded to 6 decimals (4 after iterative numerical work), counts
are BIGINT, every computed column carries the same alias on both sides, and
arrays are exploded to scalar columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None, digits: int = 6):
    """Register a query builder; its output doubles are rounded to ``digits``."""

    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = [F.round(F.col(f"`{f.name}`"), digits).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    return df.select(*cols)


def rounded(sql_body: str, double_cols: list[str], digits: int = 6) -> str:
    """Wrap a SELECT so the listed double columns are rounded like ``round_doubles``."""
    if not double_cols:
        return sql_body
    # Spark's ``round`` rounds the decimal text of the double half-up; going through the
    # shortest text and DECIMAL does the same here (plain DOUBLE rounding differs on ties).
    repl = ", ".join(
        f'(CASE WHEN isfinite("{c}") AND abs("{c}") < 1e19 '
        f'THEN round("{c}"::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE '
        f'WHEN isfinite("{c}") THEN round("{c}", {digits}) ELSE "{c}" END) AS "{c}"' for c in double_cols)
    return f"SELECT * REPLACE ({repl}) FROM (\n{sql_body}\n) AS __q"


def sql_percentile(col: str, q: float) -> str:
    """DuckDB aggregate expression equal to Spark's exact ``percentile(col, q)``.

    Spark interpolates as ``(hi - pos) * x[lo] + (pos - lo) * x[hi]``; DuckDB's
    ``quantile_cont`` uses ``x[lo] + (pos - lo) * (x[hi] - x[lo])``, which differs
    in the last bit, so the oracle spells out Spark's form.
    """
    lst = f"list_sort(list({col}) FILTER (WHERE {col} IS NOT NULL))"
    n = f"count({col})"
    p = f"({q!r}::DOUBLE * ({n} - 1))"
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN floor({p}) = {p} THEN {lst}[{p}::BIGINT + 1] "
            f"ELSE (ceil({p}) - {p}) * {lst}[floor({p})::BIGINT + 1] "
            f"+ ({p} - floor({p})) * {lst}[ceil({p})::BIGINT + 1] END)")


def sql_fmt2(expr: str) -> str:
    """DuckDB twin of ``results.fmt2``: Java's ``%.2f`` rounds the shortest decimal text
    half-up, so round through that text (as DECIMAL) before printing; null -> 'nan'."""
    return (f"(CASE WHEN ({expr}) IS NULL OR isnan({expr}) THEN 'nan' "
            f"ELSE printf('%.2f', round(({expr})::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE) END)")


def sql_resamples(src: str, by: str, value: str, key: str, n: int, seed: int = 0, block: int = 64) -> str:
    """CTEs ending with ``drawn`` (by, rep, value), the twin of ``stats.resamples``: places drawn
    by every row give the counts per block, then each block draws its own rows."""
    from platewise.functions.rand import TWO32, sql_md5_u32, sql_mix_u32

    nulls = ", ".join(f"{c.strip()} NULLS FIRST" for c in by.split(","))
    seeded = f"'{seed}:' || {key}::VARCHAR"
    own = f"'{seed}:' || g::VARCHAR || ':' || b::VARCHAR || ':' || rep::VARCHAR"
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {nulls}, {key}) - 1 AS r, {sql_md5_u32(seeded)} AS h FROM {src}),
placed AS (SELECT *, min(r) OVER (PARTITION BY {by}) AS g, count(*) OVER (PARTITION BY {by}) AS n FROM ranked),
blocks AS (SELECT {by}, g, (r - g) // {block} AS b, list({value} ORDER BY r) AS vals FROM placed GROUP BY ALL),
votes AS (SELECT g, rep, floor({sql_mix_u32('h', 'rep')} / {float(TWO32)!r}::DOUBLE * n)::BIGINT // {block} AS b, count(*) AS c
          FROM placed, range(0, {n}) t(rep) GROUP BY ALL),
dealt AS (SELECT {by}, rep, vals, {sql_md5_u32(own)} AS h, unnest(range(1, c + 1)) AS j FROM votes JOIN blocks USING (g, b)),
drawn AS (SELECT {by}, rep, vals[floor({sql_mix_u32('h', 'j')} / {float(TWO32)!r}::DOUBLE * len(vals))::BIGINT + 1] AS {value} FROM dealt)"""
