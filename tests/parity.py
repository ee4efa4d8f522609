"""Spark-vs-DuckDB parity check for the registered queries (own gate, mirrors the driver's).

Usage: python tests/parity.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

TYPE_MAP = {
    "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    return v


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_types = {f.name: TYPE_MAP.get(f.dataType.simpleString(), f.dataType.simpleString().upper()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t_spark = time.time() - t0
    if sql is None:
        return {"name": name, "ok": None, "rows": len(s_rows), "spark_s": round(t_spark, 2)}
    rel = con.sql(sql)
    d_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    problems = []
    if sorted(s_types) != sorted(d_types):
        problems.append(f"columns spark={sorted(s_types)} duck={sorted(d_types)}")
    else:
        for c in s_types:
            if s_types[c] != d_types[c]:
                problems.append(f"type {c}: spark={s_types[c]} duck={d_types[c]}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems:
        s_cols = list(s_types)
        d_cols = list(d_types)
        order = [d_cols.index(c) for c in s_cols]
        sv = sorted((tuple(_norm(v) for v in r) for r in s_rows), key=repr)
        dv = sorted((tuple(_norm(r[i]) for i in order) for r in d_rows), key=repr)
        bad = [(a, b) for a, b in zip(sv, dv) if a != b]
        if bad:
            problems.append(f"{len(bad)} value mismatches, e.g. spark={bad[0][0]} duck={bad[0][1]}")
    return {"name": name, "ok": not problems, "rows": len(s_rows), "spark_s": round(t_spark, 2), "problems": problems}


def main(argv):
    from txrisk.plans.catalog import QUERIES
    from txrisk.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    prefixes = argv[2:]
    spark = local_session(8)
    con = duck(sf_dir)
    n_ok = n_bad = 0
    for name, (fn, sql) in QUERIES.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "ok": False, "problems": [f"{type(e).__name__}: {str(e)[:400]}"]}
        flag = {True: "OK  ", False: "FAIL", None: "ROWS"}[r["ok"]]
        n_ok += r["ok"] is True
        n_bad += r["ok"] is False
        print(f"{flag} {name} rows={r.get('rows')} t={r.get('spark_s')} {'; '.join(r.get('problems', []))}", flush=True)
    print(f"ok={n_ok} fail={n_bad}")
    return n_bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
