"""Rows of a query against its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _missing(v) -> bool:
    return v is None or v is pd.NA or (isinstance(v, float) and v != v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, (["null" if _missing(v) else str(int(v)) if isinstance(v, int | float | np.integer | np.floating) and not isinstance(v, bool) and v == int(v) else str(v) for v in r] for r in frame.astype(object).values.tolist())))


def oracle(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()
