"""Compare a query's rows with those of its SQL in DuckDB."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> pd.DataFrame:
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        f = f"{sf_dir}/{t}.parquet"
        if os.path.exists(f):
            db.execute(f"create view {t} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return db.sql(sql).df()


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(_plain, v))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return float(v)
    if isinstance(v, (float, np.floating)):
        return None if v != v else round(float(v), 6)
    return v


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(_plain, r)) for r in df.itertuples(index=False)), key=repr)


def assert_same(made: pd.DataFrame, wanted: pd.DataFrame) -> None:
    assert sorted(made.columns) == sorted(wanted.columns)
    assert len(made) == len(wanted)
    for a, b in zip(rows(made), rows(wanted)):
        assert a == b
