"""Run registered queries and compare them with their oracle SQL in DuckDB.

    python -m workload.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

from workload.base import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v) if isinstance(v, bool) or v is None else repr(float(v)) if isinstance(v, int) else str(v)


def bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, q):
    """(verdict, detail, seconds)"""
    start = time.time()
    df = q.run(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if q.sql is None:
        return ("rows" if rows else "EMPTY"), f"{len(rows)} rows", took
    cur = con.execute(q.sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", f"spark {sorted(df.columns)} oracle {sorted(names)}", took
    got_bag, want_bag = bag(df.columns, rows), bag(names, want)
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    off = {
        c: (t, types[c]) for c, t in df.dtypes if kinds.get(types[c], types[c]) != t
    }
    if got_bag != want_bag:
        extra, lack = got_bag - want_bag, want_bag - got_bag
        return "DIFF", (
            f"{len(rows)} vs {len(want)} rows; columns {sorted(names)}\n    spark only {list(extra)[:3]}\n"
            f"    oracle only {list(lack)[:3]}"
        ), took
    return ("ok" if rows else "ok (0 rows)"), f"{len(rows)} rows" + (f"  types {off}" if off else ""), took


def main(sf_dir, names):
    from workload.catalog import REGISTRY
    from workload.session import local_session

    spark, con = local_session(), connect(sf_dir)
    bad = []
    for name, q in REGISTRY.items():
        if names and name not in names:
            continue
        try:
            verdict, detail, took = compare(spark, con, sf_dir, q)
        except Exception as e:  # report and go on with the next query
            verdict, detail, took = "ERROR", f"{type(e).__name__}: {str(e)[:600]}", 0.0
        if verdict in ("DIFF", "COLUMNS", "ERROR", "EMPTY"):
            bad.append(name)
        print(f"{verdict:12} {took:6.2f}s {name}: {detail}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
