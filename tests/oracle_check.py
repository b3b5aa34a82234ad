"""Run every registered query beside its SQL in DuckDB and compare: python tests/oracle_check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from faultline.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else (int(value) if value.is_integer() and abs(value) < 1e15 else value)
    if isinstance(value, (list, tuple)):
        return tuple(canonical(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, name, sf):
    start = time.time()
    frame = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return took, len(got), "rows-only"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(frame.columns):
        return took, len(got), f"COLUMNS {sorted(frame.columns)} vs {sorted(names)}"
    a, b = rows_of(frame.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return took, len(got), f"ROWS {len(a)} vs {len(b)}; {a[:2]} / {b[:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    types = [(f.name, f.dataType.simpleString()) for f in frame.schema.fields]
    other = {d[0]: str(d[1]) for d in cur.description}
    odd = [(n, t, other[n]) for n, t in types if ("HUGEINT" in other[n]) or ("DECIMAL" in other[n]) != ("decimal" in t)]
    if bad:
        return took, len(got), f"VALUES {len(bad)} differ: {bad[0]}"
    return took, len(got), "ok" + (f" (types {odd})" if odd else "")


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    failed = 0
    for name in sorted(entry.queries()):
        if len(argv) > 1 and not any(name.startswith(p) for p in argv[1:]):
            continue
        try:
            took, n, state = compare(spark, con, name, sf)
        except Exception as err:
            took, n, state = 0.0, 0, "ERROR " + str(err)[:1500]
        if not (state.startswith("ok") or state == "rows-only"):
            failed += 1
        print(f"{name:32s} {took:7.2f}s {n:8d} {state}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
