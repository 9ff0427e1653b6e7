"""Spark query vs DuckDB twin: row count, column names, order-free value hash
(doubles compared exactly)."""

from __future__ import annotations

import hashlib
import math
import os

import duckdb
import pandas as pd

from tokenmill.inputs import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if v.is_integer():
            return str(int(v))
        return repr(v)  # exact: every twin agrees to the last bit
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def frame_hash(pdf: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(pdf.columns)
    rows = sorted("|".join(_norm(r[c]) for c in cols) for r in pdf[cols].to_dict("records"))
    h = hashlib.sha256("\n".join(rows).encode()).hexdigest()
    return len(rows), cols, h


def spark_pdf(df) -> pd.DataFrame:
    return df.toPandas()


def compare(spark, name, builder, sql, sf_dir):
    s = frame_hash(spark_pdf(builder(spark, sf_dir)))
    d = frame_hash(duck(sf_dir).sql(sql).df())
    return s, d
