"""Run registered queries against DuckDB on one scale factor and report differences.

usage: python tools/compare.py [--sf 0.01] [--shuffle 8] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from wardspan.queries import ORACLES, QUERIES  # noqa: E402
from wardspan.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, norm(x)) for k, x in v.items())))
    return (type(v).__name__, str(v))


def duck(sf: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '/root/testdata/sf{sf}/{t}.parquet'")
    return con


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--shuffle", default="8")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": a.shuffle, "spark.driver.memory": "16g"})
    con = duck(a.sf)
    names = [n for n in QUERIES if not a.names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in a.names)]
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, f"/root/testdata/sf{a.sf}")
            rows = df.collect()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {n}: {str(e)[:900]}")
            continue
        dt = time.time() - t0
        cols = sorted(df.columns)
        got = Counter(tuple(norm(r[c]) for c in cols) for r in map(lambda r: r.asDict(recursive=True), rows))
        if n not in ORACLES:
            print(f"rows  {n}: {len(rows)} rows {dt:.2f}s")
            continue
        try:
            cur = con.execute(ORACLES[n])
            dcols = [d[0] for d in cur.description]
            drows = [dict(zip(dcols, r)) for r in cur.fetchall()]
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ORACLE ERROR {n}: {str(e)[:600]}")
            continue
        if sorted(dcols) != cols:
            bad += 1
            print(f"COLS  {n}: spark {cols} duck {sorted(dcols)}")
            continue
        want = Counter(tuple(norm(r[c]) for c in cols) for r in drows)
        if got == want and rows:
            print(f"ok    {n}: {len(rows)} rows {dt:.2f}s")
        else:
            bad += 1
            print(f"DIFF  {n}: spark {len(rows)} duck {len(drows)} {dt:.2f}s", "EMPTY" if not rows else "")
            for lab, d in (("spark only", got - want), ("duck only", want - got)):
                for r, c in sorted(d.items(), key=str)[:4]:
                    print("   ", lab, c, dict(zip(cols, r)))
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
