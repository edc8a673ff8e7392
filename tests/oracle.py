"""Rows of a query against those of its SQL twin."""

import glob
import os
import re

import duckdb
import pandas as pd


def connect(d):
    con = duckdb.connect()
    for p in glob.glob(os.path.join(d, "*.parquet")):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def rows(df):
    def text(v):
        if hasattr(v, "tolist"):
            return str(v.tolist())
        if v is None or (not isinstance(v, (list, tuple, dict, str)) and pd.isna(v)):
            return "NULL"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(text(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def same(spark, con, d, query, sql):
    got, want = rows(query(spark, d).toPandas()), rows(con.sql(sql).df())
    assert got[0] == want[0]
    number = re.compile(r"-?\d{1,17}(\.\d+)?(e[+-]?\d+)?")
    fix = lambda rs: sorted(tuple(f"{float(x):.9g}" if number.fullmatch(x) else x for x in r) for r in rs)
    assert fix(got[1]) == fix(want[1])
