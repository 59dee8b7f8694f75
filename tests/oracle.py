"""A Spark result against DuckDB's for the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(sf_dir + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(df, con, sql: str) -> None:
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    key = lambda x: tuple((v is not None, str(v)) for v in x)
    got = sorted((tuple(plain(row[c]) for c in cols) for row in df.collect()), key=key)
    want = sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=key)
    assert got == want
