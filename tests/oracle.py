"""Compare a Spark result with DuckDB's, whatever the order of rows."""

import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path).split('.')[0]} as select * from '{source}'")
    return con


def cell(v):
    import datetime
    import decimal

    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def same(df, con, sql):
    got = rows(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want
    return got
