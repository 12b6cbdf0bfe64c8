"""Run registered queries beside their check SQL and compare every value.

usage: python tools/check.py SF_DIR [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cutover.plans import all_oracles, all_queries  # noqa: E402
from cutover.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, con, folder: str, name: str) -> tuple[str, int, float]:
    started = time.time()
    df = all_queries()[name](spark, folder)
    ours = df.collect()
    took = time.time() - started
    sql = all_oracles().get(name)
    if sql is None:
        return "no sql", len(ours), took
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(set(columns) ^ set(df.columns))}", len(ours), took
    left, right = rows_of(df.columns, ours), rows_of(columns, result.fetchall())
    if left == right:
        return "ok" if ours else "ok (empty)", len(ours), took
    only_l, only_r = list((left - right).elements()), list((right - left).elements())
    return f"DIFFERS {sum(left.values())} vs {sum(right.values())} rows\n   {sorted(columns)}\n   spark {only_l[:2]}\n   sql   {only_r[:2]}", len(ours), took


def main(folder: str, prefixes: list[str]) -> int:
    spark, con, bad = local_session(8, "check"), connect(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in sorted(all_queries()):
        if prefixes and not name.startswith(tuple(prefixes)):
            continue
        try:
            verdict, n, took = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            verdict, n, took = f"FAILED {type(e).__name__}: {str(e)[:600]}", -1, 0.0
        bad += not (verdict.startswith("ok") or verdict == "no sql")
        print(f"{name:45} {n:8} {took:6.2f}s {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1].rstrip("/"), sys.argv[2:]) > 0)
