"""Run catalog queries beside their DuckDB SQL and compare every row: python tests/oracle_check.py [sf] [names]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return value + 0.0
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(canonical(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_df, con, sql: str) -> str:
    mine_cols, mine = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    got = con.execute(sql)
    cols = [c[0] for c in got.description]
    theirs = got.fetchall()
    if sorted(mine_cols) != sorted(cols):
        return f"columns differ: {sorted(set(mine_cols) ^ set(cols))}"
    if len(mine) != len(theirs):
        return f"rows differ: {len(mine)} vs {len(theirs)}"
    a, b = rows_of(mine_cols, mine), rows_of(cols, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first: {bad[0]}" if bad else "ok"


def main() -> int:
    import __spark_entry__ as entry
    from meltframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(cores=int(os.environ.get("ORACLE_CORES", "8"))), connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in wanted or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                verdict = compare(df, con, oracle[name])
            else:
                verdict = f"ok (rows only: {df.count()})"
        except Exception as error:  # noqa: BLE001 - reported, then counted
            verdict = f"error {type(error).__name__}: {str(error)[:600]}"
        failed += not verdict.startswith("ok")
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict[:700]}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
