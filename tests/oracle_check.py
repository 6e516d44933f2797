"""Run registered queries beside their DuckDB twins and compare whole results.

    python -m tests.oracle_check [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, (list, tuple)):
            return tuple(v)
        if isinstance(v, (int, float)):
            return float(v)
        return v
    rows = [tuple(cell(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(left: pd.DataFrame, right: pd.DataFrame, tolerance: float = 0.0) -> str | None:
    """None when both hold the same rows, else what differs."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = _plain(left), _plain(right)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)} rows"
    differing = [(x, y) for x, y in zip(a, b) if x != y and not _close(x, y, tolerance)]
    return None if not differing else f"{len(differing)} of {len(a)} rows differ, first: {differing[0]} (columns {sorted(left.columns)})"


def _close(x: tuple, y: tuple, tolerance: float) -> bool:
    return tolerance > 0 and all(
        p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= tolerance) for p, q in zip(x, y))


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from lineside.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(folder)
    jobs, sql = queries(), oracle_sql()
    bad = 0
    for name in args or jobs:
        began = time.time()
        try:
            got = jobs[name](spark, folder).toPandas()
            spent = time.time() - began
            verdict = "no SQL twin" if name not in sql else compare(got, con.execute(sql[name]).df()) or "ok"
        except Exception as error:  # report and go on with the next query
            traceback.print_exc(limit=-3)
            spent, verdict, got = time.time() - began, f"FAILED {str(error)[:600]}", pd.DataFrame()
        bad += verdict not in ("ok", "no SQL twin")
        print(f"{name:34s} {spent:6.1f}s {len(got):7d} rows  {verdict}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
