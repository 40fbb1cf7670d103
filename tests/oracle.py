"""Runs a query and its DuckDB SQL over the same tables and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(data: str = DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = Path(data, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, list | tuple):
        return [plain(x) for x in value]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(str([plain(r[i]) for i in order]) for r in rows)


def same(df, con, sql: str) -> None:
    found = con.sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(found.columns, found.fetchall())
