"""Run registered queries next to their SQL and compare schema, row count and values.

    python check.py [name-part ...]      # folder from CHECK_SF_DIR, default sf0.01
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from quillframe.session import build_session, remove_tables, scratch_tables
from workload import ORACLE, QUERIES
from workload.base import TABLES


def session():
    spark = build_session("check", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                          spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cell(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, float):
        return repr(value + 0.0 if value else 0.0)
    return str(value)


def pandas_of(df) -> pd.DataFrame:
    """The rows of a Spark table; whole numbers stay whole beside nulls."""
    return df.toPandas().astype({c: {"bigint": "Int64", "int": "Int32"}[kind] for c, kind in df.dtypes if kind in ("bigint", "int")})


def shape(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False))


def kind(dtype) -> str:
    text = str(dtype)
    return {"object": "str", "string": "str", "Int64": "int64", "Int32": "int32"}.get(text, text)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = shape(got), shape(want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ of {len(a)}: {sorted(got.columns)}\n  got  {bad[0][0]}\n  want {bad[0][1]}"
    odd = [(c, kind(got[c].dtype), kind(want[c].dtype)) for c in got.columns if kind(got[c].dtype) != kind(want[c].dtype)]
    return f"ok (types {odd})" if odd else "ok"


def main(parts: list[str]) -> int:
    folder = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    spark = session()
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    bad = 0
    for name, run in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            got = pandas_of(run(spark, folder))
            took = time.time() - start
            if name not in ORACLE:
                verdict = f"rows only ({len(got)})"
            else:
                verdict = compare(got, con.execute(ORACLE[name]).df())
        except Exception as error:
            took = time.time() - start
            verdict = f"ERROR {str(error)[:1500]}"
            if os.environ.get("CHECK_TRACE"):
                traceback.print_exc()
        remove_tables(spark, scratch_tables())
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {took:6.2f}s {verdict}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
