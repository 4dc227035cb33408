"""Runs a query and its SQL, and compares the rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6f}".removesuffix(".000000")
    return str(int(v)) if type(v).__name__.startswith(("bool", "int", "uint")) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(_cell, r)) for r in frame[names].itertuples(index=False))


def agree(spark, sf_dir, query, sql):
    got, want = rows(query(spark, sf_dir).toPandas()), rows(connect(sf_dir).sql(sql).df())
    assert got[0] == want[0]
    assert got[1] == want[1]
