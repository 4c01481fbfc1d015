"""Run registered queries next to their SQL and compare the results. Usage: oracle_check.py <sf> [name part ...]"""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return f"{type(v).__name__}:{v}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows([d[0] for d in cur.description], cur.fetchall())
    return left, right


def main(sf: str, parts: list[str]) -> int:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, bad = local_session(), connect(sf_dir), 0
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            if name not in sqls:
                print(f"rows  {name}: {fn(spark, sf_dir).count()} rows, no SQL ({time.time() - t:.1f}s)", flush=True)
                continue
            left, right = compare(spark, con, fn, sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {str(e)[:1500]}", flush=True)
            continue
        n = sum(left[1].values())
        if left == right:
            print(f"ok    {name}: {n} rows ({time.time() - t:.1f}s)", flush=True)
        else:
            bad += 1
            print(f"DIFF  {name}: {n} vs {sum(right[1].values())} rows, columns {left[0]} {right[0]}")
            print("   spark only:", list((left[1] - right[1]).items())[:4])
            print("   sql only:  ", list((right[1] - left[1]).items())[:4], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
