"""Row-by-row comparison of a Spark result with DuckDB on the same parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if value is None or isinstance(value, (int, str, bool)):
        return value
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def differences(spark_df, con, sql: str, limit: int = 5) -> list[str]:
    got_cols, got = _sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_cols, want = _sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} != {want_cols}"]
    if len(got) != len(want):
        return [f"rows {len(got)} != {len(want)}; first {got[:2]} {want[:2]}"]
    return [f"{a} != {b}" for a, b in zip(got, want) if a != b][:limit]
