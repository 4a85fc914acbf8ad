"""Spark results beside DuckDB results."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 8) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value) if abs(value) < 2**53 else value
    return str(value)[:10] if type(value).__name__ in ("date", "datetime", "Timestamp") else value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(spark_df, con, sql: str) -> None:
    got_columns = spark_df.columns
    got = rows(got_columns, spark_df.collect())
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(got_columns)
    want = rows(columns, rel.fetchall())
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        if a != b:
            close = all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-7, abs_tol=2e-8)) for x, y in zip(a, b, strict=True))
            assert close, (a, b)
