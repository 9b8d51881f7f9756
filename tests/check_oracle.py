"""Compare every driver query with its SQL: `python tests/check_oracle.py [folder] [names]`."""

from __future__ import annotations

import importlib.util
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def load_entry():
    spec = importlib.util.spec_from_file_location("spark_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return con


def sorted_frame(frame: pd.DataFrame) -> pd.DataFrame:
    """Rows and columns in order; integers with nulls in one type, whichever engine made them."""
    frame = frame[sorted(frame.columns)]
    nullable = {c: "float64" for c in frame.columns if str(frame[c].dtype) == "Int64"}
    frame = frame.astype(nullable)
    return frame.sort_values(list(frame.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both frames hold the same rows, columns and plain types."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} against {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    got, want = sorted_frame(got), sorted_frame(want)
    for column in got.columns:
        a, b = got[column], want[column]
        if a.dtype != b.dtype:
            return f"{column}: {a.dtype} against {b.dtype}"
        differs = (a != b) & ~(a.isna() & b.isna())
        if differs.any():
            at = differs.idxmax()
            return f"{column} row {at}: {a[at]!r} against {b[at]!r}"
    return ""


def main() -> int:
    from changelens.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    entry = load_entry()
    queries, sql = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    spark, con = local_session(), duck(folder)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        begin = time.time()
        try:
            got = queries[name](spark, folder).toPandas()
            spent = time.time() - begin
            problem = difference(got, con.sql(sql[name]).df()) if name in sql else "no SQL"
        except Exception as error:  # a report of all queries is wanted, whatever fails
            problem, got, spent = str(error)[:700], [], time.time() - begin
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok':5}{name} rows={len(got)} {spent:.2f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return int(failed > 0)


if __name__ == "__main__":
    sys.exit(main())
