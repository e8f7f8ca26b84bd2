"""DuckDB over the driver tables, and comparison of results without order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _text(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted(map(tuple, df[cols].map(_text).values.tolist())) for df in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
