"""Spark-vs-DuckDB comparison used by the tests and by hand (``python tests/oracle.py key ...``)."""

from __future__ import annotations

import math
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def frame_rows(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, key: str, sf_dir: str, queries: dict, oracles: dict, con=None) -> tuple[bool, str]:
    sdf = queries[key](spark, sf_dir)
    sp = sdf.toPandas()
    if key not in oracles:
        return True, f"{key}: {len(sp)} rows (no oracle)"
    con = con or duck(sf_dir)
    dk = con.execute(oracles[key]).df()
    duck_types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {oracles[key]}").fetchall()}
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                   for f in sdf.schema.fields}
    if spark_types != duck_types:
        diff = {c: (spark_types.get(c), duck_types.get(c)) for c in set(spark_types) | set(duck_types)
                if spark_types.get(c) != duck_types.get(c)}
        return False, f"{key}: column types differ {diff}"
    if sorted(sp.columns) != sorted(dk.columns):
        return False, f"{key}: columns differ spark={sorted(sp.columns)} duck={sorted(dk.columns)}"
    if len(sp) != len(dk):
        return False, f"{key}: rows differ spark={len(sp)} duck={len(dk)}"
    a, b = frame_rows(sp), frame_rows(dk)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{key}: {len(bad)} value mismatches, first: spark={bad[0][0]} duck={bad[0][1]}"
    return True, f"{key}: {len(sp)} rows match"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import time

    import __spark_entry__ as E
    from platewise.session import local_session

    spark = local_session()
    sf = "/root/testdata/sf0.01"
    qs, os_ = E.queries(), E.oracle_sql()
    keys = sys.argv[1:] or list(qs)
    con = duck(sf)
    failed = 0
    for k in keys:
        t = time.time()
        try:
            ok, msg = compare(spark, k, sf, qs, os_, con)
        except Exception as e:  # report and continue
            ok, msg = False, f"{k}: ERROR {type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(("OK  " if ok else "BAD ") + msg + f"  [{time.time() - t:.1f}s]", flush=True)
    print(f"{len(keys) - failed}/{len(keys)} ok")
