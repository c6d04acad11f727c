"""Compares a Spark result with DuckDB's, row by row in any order."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype") or hasattr(v, "as_tuple"):
        return f"{float(v) + 0.0:.4f}"
    return str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(map(_text, r)) for r in frame.itertuples(index=False))
