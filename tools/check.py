"""Run registered queries and their SQL side by side and report differences.

usage: python tools/check.py [--sf DIR] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from corpusmill.catalog import all_queries, all_sql  # noqa: E402
from corpusmill.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(value) -> str:
    return "float" if isinstance(value, float) else "bool" if isinstance(value, bool) else type(value).__name__


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark, con, name: str, query, sql: str | None, sf_dir: str) -> str:
    start = time.time()
    df = query(spark, sf_dir)
    ours = df.collect()
    took = time.time() - start
    if sql is None:
        return f"rows  {name}: {len(ours)} rows, {took:.1f}s"
    start = time.time()
    cursor = con.execute(sql)
    theirs_names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    other = time.time() - start
    names, a = plain([tuple(r) for r in ours], df.columns)
    other_names, z = plain(theirs, theirs_names)
    if names != other_names:
        return f"FAIL  {name}: columns {names} != {other_names}"
    if len(a) != len(z):
        return f"FAIL  {name}: {len(a)} rows != {len(z)}"
    types = {
        (n, kind(x), kind(y)) for r, s in zip(a, z) for n, x, y in zip(names, r, s)
        if x is not None and y is not None and kind(x) != kind(y)
    }
    if types:
        return f"FAIL  {name}: types {sorted(types)[:4]}"
    bad = [(r, s) for r, s in zip(a, z) if r != s]
    if bad:
        cells = [(n, x, y) for n, x, y in zip(names, *bad[0]) if x != y]
        return f"FAIL  {name}: {len(bad)}/{len(a)} rows differ, first {str(cells)[:400]} key {str(bad[0][0])[:120]}"
    return f"ok    {name}: {len(a)} rows, {took:.1f}s (sql {other:.1f}s)" + ("  EMPTY" if not a else "")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(args.sf), all_sql()
    failed = 0
    for name, query in all_queries().items():
        if args.names and not any(part in name for part in args.names):
            continue
        try:
            line = compare(spark, con, name, query, sql.get(name), args.sf)
        except Exception as error:  # report and go on
            line = f"FAIL  {name}: {type(error).__name__} {str(error)[:700]}"
        failed += line.startswith("FAIL")
        print(line, flush=True)
    print("failed:", failed)
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
