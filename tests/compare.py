"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf_dir] [names...]."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows with columns sorted by name, values as exact text, rows sorted."""

    def text(v) -> str:
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if type(v).__name__ in ("float64", "float"):
            return repr(float(v))
        if hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if type(v).__name__.startswith(("int", "Int")):
            return str(int(v))
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(text(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def duck_frame(con, sql: str) -> pd.DataFrame:
    table = con.sql(sql).to_arrow_table()
    return pd.DataFrame({n: table.column(n).to_pylist() for n in table.column_names}, dtype=object)


def spark_frame(df) -> pd.DataFrame:
    table = df.toArrow()
    return pd.DataFrame({n: table.column(n).to_pylist() for n in table.column_names}, dtype=object)


def difference(spark, con, name: str, sf_dir: str) -> tuple[str | None, int]:
    """None when equal, else a short description; and the row count."""
    got = spark_frame(entry.queries()[name](spark, sf_dir))
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, len(got)
    want = duck_frame(con, sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}", len(got)
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        x, y = bad[0]
        cols = sorted(got.columns)
        cells = [(n, p, q) for n, p, q in zip(cols, x, y) if p != q]
        return f"{len(bad)} rows differ, first {x[:3]}: {cells[:4]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from ledgerlynx.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session("compare"), connect(sf)
    failed = []
    for name in sys.argv[2:] or entry.queries():
        t0 = time.time()
        try:
            problem, rows = difference(spark, con, name, sf)
        except Exception as e:  # noqa: BLE001
            problem, rows = f"{type(e).__name__}: {str(e)[:600]}", 0
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:22s} {rows:7d} {time.time() - t0:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
