"""Compare registered queries with their SQL on one data folder: python tests/check_oracle.py [regex] [folder]."""

import math
import re
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tidebars.plans.catalog import catalog  # noqa: E402
from tidebars.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(float(v))
    return str(v)


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return sorted(tuple(cell(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None))


def compare(spark, con, name, fn, sql, folder):
    t = time.time()
    got = fn(spark, folder).toPandas()
    ts = time.time() - t
    if sql is None:
        return len(got) > 0, f"rows only {len(got)}", ts, 0
    t = time.time()
    want = con.sql(sql).df()
    to = time.time() - t
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}", ts, to
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return len(a) > 0, f"{len(a)} rows", ts, to
    sa, sb = set(a), set(b)
    return False, f"{len(a)} vs {len(b)} rows; only spark {len(sa - sb)} {sorted(sa - sb)[:2]}; only sql {len(sb - sa)} {sorted(sb - sa)[:2]}", ts, to


if __name__ == "__main__":
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    folder = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.01"
    spark, con, bad = local_session(), connect(folder), []
    for name, (fn, sql) in catalog().items():
        if not re.search(pattern, name):
            continue
        try:
            ok, note, ts, to = compare(spark, con, name, fn, sql, folder)
        except Exception as e:  # noqa: BLE001
            ok, note, ts, to = False, f"{type(e).__name__}: {str(e)[:600]}", 0, 0
        if not ok:
            bad.append(name)
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {ts:6.2f}s sql {to:5.2f}s  {note}", flush=True)
    print("failed:", bad)
