"""Rows of a Spark query against DuckDB's, as multisets."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "NULL"
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, str):
        return v
    return f"{float(v):.9g}"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))
