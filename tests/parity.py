"""Rows of a Spark result and of DuckDB, in one form."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, list):
        return tuple(canon(x) for x in v)
    return v


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(canon(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    found = con.sql(sql)
    names = list(found.columns)
    columns = sorted(names)
    return columns, sorted((tuple(canon(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
