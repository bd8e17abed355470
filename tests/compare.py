"""Run registered queries next to their SQL and report differences.

``python tests/compare.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canon(value):
    if value is None:
        return ("", "")
    if isinstance(value, bool):
        return ("b", str(value))
    if isinstance(value, float):
        if math.isnan(value):
            return ("", "")
        return ("n", f"{value:.9g}") if value != int(value) else ("n", str(int(value)))
    if isinstance(value, int):
        return ("n", str(value))
    if type(value).__name__ == "Decimal":
        return canon(float(value))
    return ("s", str(value))


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canon(r[i]) for i in order) for r in records)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, run, sql, sf_dir):
    """None when both engines agree, else a short description; and the row count."""
    df = run(spark, sf_dir)
    columns, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(mine)
    result = con.execute(sql)
    expected_columns, theirs = rows_of([c[0] for c in result.description], result.fetchall())
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}", len(mine)
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return f"{len(mine)} rows vs {len(theirs)}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}", len(mine)
    return None, len(mine)


def main():
    import __spark_entry__ as entry
    from offerlens.plans.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            problem, n = difference(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # keep going: the report lists every query
            problem, n = f"{type(error).__name__}: {str(error)[:1500]}", -1
        bad += problem is not None
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s{'' if name in oracles else ' (no sql)'} {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
