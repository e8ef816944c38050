"""Run registered queries against their SQL oracles: python tests/check_oracles.py [sf] [name-regex]."""

from __future__ import annotations

import re
import sys
import time
import traceback

import duckdb

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    import datetime
    import decimal
    if hasattr(v, "item"):
        v = v.item()
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return repr(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(x) for x in df.collect()]
    took = time.time() - t
    if sql is None:
        return None, f"rows={len(got)} (no oracle)", took
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}", took
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return len(a) > 0, f"rows={len(a)}" + ("" if a else " EMPTY"), took
    only_a = [x for x in a if x not in set(b)][:3]
    only_b = [x for x in b if x not in set(a)][:3]
    return False, f"rows {len(a)} vs {len(b)}\n   cols {sorted(names)}\n   spark {only_a}\n   sql   {only_b}", took


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    pattern = re.compile(sys.argv[2] if len(sys.argv) > 2 else ".")
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad, none, start = [], [], time.time()
    for name, fn in queries.items():
        if not pattern.search(name):
            continue
        try:
            ok, note, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as exc:
            ok, note, took = False, str(exc)[:420], 0.0
            if "-v" in sys.argv:
                traceback.print_exc()
        if ok is None:
            none.append(name)
        elif not ok:
            bad.append(name)
        print(("ok  " if ok else "--  " if ok is None else "BAD ") + f"{name} {took:.1f}s {note}", flush=True)
    print(f"{len(queries)} queries, {len(oracles)} oracles, bad={bad}, no oracle={none}, {time.time() - start:.0f}s")


if __name__ == "__main__":
    main()
