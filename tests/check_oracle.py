"""Runs registered queries against their SQL in DuckDB.

    python tests/check_oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from benchloom.catalog.views import BASE  # noqa: E402


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, Decimal)):
        f = float(value)
        return "nan" if math.isnan(f) else round(f, 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(canon(r[i]) for i in order) for r in rows], key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in BASE:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    t = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s", True
    t = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    duck_took = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(cols)}", False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"ok {len(a)} rows {took:.1f}s (sql {duck_took:.1f}s)", True
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return f"DIFF {len(a)} vs {len(b)} rows\n   spark {str(only_a)[:700]}\n   sql   {str(only_b)[:700]}", False


def main():
    import __spark_entry__ as entry
    from benchloom.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session(8)
    con = duck(folder)
    bad = []
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            message, ok = compare(spark, con, folder, name, fn, entry.oracle_sql().get(name))
        except Exception as exc:  # noqa: BLE001
            message, ok = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", False
        print(f"{name}: {message}", flush=True)
        if not ok:
            bad.append(name)
    print("FAILED:" if bad else "all good", *bad)
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
