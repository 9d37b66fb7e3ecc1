"""Runs the registered queries beside their SQL and compares the rows.

    python tools/compare.py [folder] [name part ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from checks import ORACLES, QUERIES  # noqa: E402
from checks.standins import BASE  # noqa: E402
from reportlake.session import local_session  # noqa: E402


def connect(folder: str):
    connection = duckdb.connect()
    for name in BASE:
        path = f"{folder}/{name}.parquet"
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def as_rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: str, name: str) -> tuple[str, int]:
    """("ok" or a description of the difference, number of rows)."""
    result = QUERIES[name](spark, folder)
    mine = as_rows(result.columns, [tuple(r) for r in result.collect()])
    size = sum(mine.values())
    if name not in ORACLES:
        return "ok (rows only)", size
    cursor = connection.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    theirs = as_rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(result.columns):
        return f"columns differ: {sorted(result.columns)} / {sorted(columns)}", size
    if mine != theirs:
        only_mine = list((mine - theirs).items())[:2]
        only_theirs = list((theirs - mine).items())[:2]
        return f"rows differ ({size}/{sum(theirs.values())}): {only_mine} / {only_theirs}", size
    return "ok", size


def main(arguments: list[str]) -> int:
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    parts = arguments[1:]
    spark = local_session("8", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    connection = connect(folder)
    failed = 0
    for name in QUERIES:
        if parts and not any(part in name for part in parts):
            continue
        began = time.time()
        try:
            verdict, size = compare(spark, connection, folder, name)
        except Exception as problem:
            verdict, size = f"failed: {str(problem)[:1500]}", -1
        failed += not verdict.startswith("ok")
        print(f"{name:45} {size:8} {time.time() - began:6.1f}s {verdict[:1500]}", flush=True)
    print(f"{failed} of {len(QUERIES)} differ")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
