"""Run a registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

from tideglass.sources.bindings import BASE_TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"f:{v!r}"
    if isinstance(v, (int, datetime)):
        return f"{type(v).__name__}:{v}"
    if isinstance(v, (Decimal, date, list, dict, tuple)):
        raise TypeError(f"output type not portable between engines: {type(v)} {v}")
    return f"{type(v).__name__}:{v}"


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in cur.fetchall())


def difference(df, con, sql) -> str | None:
    sc, sr = spark_rows(df)
    dc, dr = duck_rows(con, sql)
    if sc != dc:
        return f"columns differ: {sc} != {dc}"
    if sr != dr:
        only_s, only_d = sr - dr, dr - sr
        return (
            f"rows {sum(sr.values())} vs {sum(dr.values())}; only spark {sum(only_s.values())} "
            f"{list(only_s)[:3]}; only sql {sum(only_d.values())} {list(only_d)[:3]}; columns {sc}"
        )
    return None
