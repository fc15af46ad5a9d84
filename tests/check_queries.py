"""Run registered queries against their SQL on DuckDB: python tests/check_queries.py [names...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from weftline.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def open_duckdb(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(cell(r[i]) for i in order) for r in rows], key=repr)


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def compare(df, con, sql):
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows={len(rows)} (no sql)", True
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", False
    bad = [(n, t, kinds[n]) for n, t in df.dtypes if KIND.get(t, t) != kinds[n] and not t.startswith(("array", "map", "struct"))]
    if bad:
        return f"types {bad}", False
    a, b = canon(df.columns, rows), canon(names, want)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        return f"rows {len(a)} vs {len(b)}; first diffs {str(diff)[:900]}", False
    return f"rows={len(a)}", True


def main():
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(8)
    con = open_duckdb(folder)
    qs, sqls = E.queries(), E.oracle_sql()
    names = sys.argv[1:] or list(qs)
    picked = [n for n in qs if any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)] if sys.argv[1:] else names
    failed = []
    for n in picked:
        t0 = time.time()
        try:
            msg, ok = compare(qs[n](spark, folder), con, sqls.get(n))
        except Exception as e:  # noqa: BLE001
            msg, ok = f"{type(e).__name__}: {str(e)[:700]}", False
        print(f"{'ok  ' if ok else 'FAIL'} {n} {time.time() - t0:.1f}s {msg}", flush=True)
        if not ok:
            failed.append(n)
    print(f"{len(picked) - len(failed)}/{len(picked)} ok; failed: {failed}")


if __name__ == "__main__":
    main()
