"""Runs registered queries against their SQL counterparts in DuckDB.

    python check.py [sf_dir] [name or prefix ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from stichos.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if value is None or (isinstance(value, float) and np.isnan(value)) or value is pd.NaT or value is pd.NA:
        return "NULL"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (float, np.floating)):
        return str(int(value)) if float(value).is_integer() else f"{value:.6f}"
    return str(value)


def rows_of(df: pd.DataFrame) -> list:
    cols = sorted(df.columns)
    return sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


def check(spark, con, name, fn, sql, sf) -> bool:
    t = time.time()
    got = fn(spark, sf).toPandas()
    spent = time.time() - t
    if sql is None:
        print(f"rows  {name}: {len(got)} rows, {spent:.1f}s", flush=True)
        return True
    t = time.time()
    want = con.execute(sql).df()
    a, b = rows_of(got), rows_of(want)
    ok = sorted(got.columns) == sorted(want.columns) and a == b
    print(f"{'ok   ' if ok else 'FAIL '} {name}: {len(a)} / {len(b)} rows, {spent:.1f}s, sql {time.time() - t:.1f}s", flush=True)
    if not ok:
        print("   columns", sorted(got.columns), sorted(want.columns))
        sa, sb = set(a), set(b)
        for r in sorted(sa - sb)[:4]:
            print("   spark ", r)
        for r in sorted(sb - sa)[:4]:
            print("   sql   ", r)
        for col in sorted(got.columns):
            if col in want.columns and str(got[col].dtype) != str(want[col].dtype):
                print("   type", col, got[col].dtype, want[col].dtype)
    return ok


def main() -> int:
    from queries import all_oracles, all_queries

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    picks = args[1:]
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    queries, oracles, bad = all_queries(), all_oracles(), []
    for name, fn in queries.items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        try:
            if not check(spark, con, name, fn, oracles.get(name), sf):
                bad.append(name)
        except Exception as e:                                    # report and go on
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            bad.append(name)
    print("failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
