"""Run registered queries in Spark and their oracle SQL in DuckDB and compare.

Comparison: row count, column names (sorted), and an order-insensitive multiset
of canonicalised rows (floats rounded to 6 places, nested values as text).

    python -m tests.oracle [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import json
import math
import os
import sys
import time

import duckdb
import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weft.sources.files import TABLE_NAMES  # noqa: E402


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return None
    if isinstance(v, (np.generic,)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return int(r) if r == int(r) and abs(r) < 2**53 else r
    if isinstance(v, decimal.Decimal):
        return _canon(float(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, np.ndarray):
        return [_canon(x) for x in v.tolist()]
    if isinstance(v, (list, tuple)):
        return [_canon(x) for x in v]
    if isinstance(v, dict):
        return {k: _canon(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: _canon(x) for k, x in v.asDict().items()}
    if isinstance(v, bytes):
        return v.hex()
    return v


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [json.dumps([_canon(r[i]) for i in order], sort_keys=True, default=str) for r in rows]
    return sorted(columns), sorted(out)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res["oracle_rows"] = len(drows)
    c1, r1 = canon_rows(scols, srows)
    c2, r2 = canon_rows(dcols, drows)
    if c1 != c2:
        res["status"] = f"COLUMNS spark={c1} oracle={c2}"
    elif len(r1) != len(r2):
        res["status"] = "ROWCOUNT"
    elif r1 != r2:
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:2]
        res["status"] = f"VALUES e.g. {diff}"
    else:
        res["status"] = "ok"
    return res


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args(argv)
    sf_dir = f"/root/testdata/sf{args.sf}"
    import __spark_entry__ as entry
    from weft.session import build_session

    spark = build_session(shuffle_partitions=8)
    qs, ors = entry.queries(), entry.oracle_sql()
    con = duck(sf_dir)
    names = args.names or sorted(qs)
    bad = 0
    for n in names:
        try:
            r = compare(spark, con, n, qs[n], ors.get(n), sf_dir)
        except Exception as exc:  # noqa: BLE001
            r = {"name": n, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(json.dumps(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} ok", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
