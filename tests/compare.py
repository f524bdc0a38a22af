"""Run registered queries and their oracle text on one scale factor and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, fn, sql, sf_dir, show=3):
    t = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - t
    if sql is None:
        return f"{name}: rows-only {len(got)} ({spent:.1f}s)", bool(got)
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"{name}: COLUMNS {sorted(df.columns)} != {sorted(cols)}", False
    if got != want:
        a, b = set(got), set(want)
        text = f"{name}: DIFF spark={len(got)} oracle={len(want)}"
        for label, side in (("spark only", sorted(a - b, key=repr)), ("oracle only", sorted(b - a, key=repr))):
            for r in side[:show]:
                text += f"\n   {label}: {str(r)[:400]}"
        return text, False
    return f"{name}: ok {len(got)} ({spent:.1f}s)", True


def main(argv):
    from repoaudit.queries import ORACLES, QUERIES
    from repoaudit.session import build_session

    sf = argv[0]
    names = [n for n in QUERIES if not argv[1:] or any(a in n for a in argv[1:])]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("compare", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for n in names:
        try:
            text, ok = compare(spark, con, n, QUERIES[n], ORACLES.get(n), sf_dir)
        except Exception as exc:  # noqa: BLE001
            text, ok = f"{n}: ERROR {str(exc)[:1500]}", False
        bad += not ok
        print(("" if ok else "!! ") + text, flush=True)
    print(f"{len(names)} queries, {bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
