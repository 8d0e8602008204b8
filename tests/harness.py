"""Run registered queries and compare them with their SQL in DuckDB (columns by name, rows as a bag)."""

from __future__ import annotations

import math
import sys
import time

import duckdb

ROOT = "/root/testdata"


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    from poolcall.plans.fixtures import BASE_TABLES
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/{sf}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    if isinstance(v, dict):
        return {k: norm(x) for k, x in v.items()}
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted([repr([norm(r[k]) for k in order]) for r in rows]), [cols[k] for k in order]


KIND = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
        "INTEGER[]": "array<int>", "BIGINT[]": "array<bigint>", "VARCHAR[]": "array<string>", "DOUBLE[]": "array<double>",
        "FLOAT": "float", "TIMESTAMP": "timestamp_ntz"}


def compare(spark, con, name, sf):
    from poolcall.plans.registry import ORACLES, QUERIES
    t0 = time.time()
    df = QUERIES[name](spark, f"{ROOT}/{sf}")
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return len(got) > 0, f"{len(got)} rows, no SQL, {t1 - t0:.1f}s"
    cur = con.execute(ORACLES[name])
    cols, types = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    t2 = time.time()
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s"
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(cols, want)
    if ca != cb:
        return False, f"columns {ca} != {cb}; {note}"
    st = dict(df.dtypes)
    bad = [f"{c}: {st[c]} vs {t}" for c, t in zip(cols, types) if KIND.get(t, t) != st[c]]
    if bad:
        return False, f"types {bad}; {note}"
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"values differ, {len(sa - sb)} only spark, {len(sb - sa)} only sql of {len(a)}/{len(b)}; {sorted(sa - sb)[:3]} | {sorted(sb - sa)[:3]}; {note}"
    if not got:
        return False, f"empty; {note}"
    return True, note


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from poolcall.session import build_session
    sf = sys.argv[1]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                  "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    e.queries()
    pick = sys.argv[2:]
    names = [n for n in e.queries() if not pick or any(n.startswith(p) for p in pick)]
    fails = 0
    for n in names:
        try:
            ok, note = compare(spark, con, n, sf)
        except Exception as ex:  # report and go on with the next query
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:900]}"
        fails += not ok
        print(("ok   " if ok else "FAIL ") + n, note, flush=True)
    print(f"{len(names) - fails}/{len(names)} ok")
