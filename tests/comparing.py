"""Order-insensitive comparison of a Spark result and DuckDB SQL over the same Parquet tables."""

from __future__ import annotations

import datetime

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, (bool, np.bool_)):
        return None if x is None else str(bool(x))
    if isinstance(x, (float, np.floating)):
        return None if x != x else f"{x:.9g}"
    if isinstance(x, (int, np.integer)):
        return f"{x:.9g}" if abs(x) < 1e9 else str(int(x))
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def spark_rows(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted(str([plain(r[c]) for c in columns]) for r in df.collect())


def duck_rows(c: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[str]]:
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(x) for x in columns]
    return columns, sorted(str([plain(r[i]) for i in at]) for r in found.fetchall())
