"""Run every query against its SQL oracle on one data folder and report differences.

    python tools/check_oracle.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from chatstream.plans.oracle import ORACLE  # noqa: E402
from chatstream.plans.queries import QUERIES  # noqa: E402
from chatstream.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, Decimal):
        return int(value) if value == int(value) else float(value)
    if isinstance(value, float) and value.is_integer():
        return int(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in data)


def main(sf_dir: str = "/root/testdata/sf0.01", *names: str) -> int:
    spark = build_session("check", "local[8]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    failures = 0
    for name in names or QUERIES:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            got = rows(df.columns, df.collect())
            seconds = time.time() - started
            if name not in ORACLE:
                print(f"rows  {name:30s} {sum(got.values()):8d} {seconds:6.2f}s")
                continue
            result = con.execute(ORACLE[name])
            columns = [c[0] for c in result.description]
            want = rows(columns, result.fetchall())
            same = got == want and sorted(columns) == sorted(df.columns)
            print(f"{'ok   ' if same else 'DIFF '} {name:30s} {sum(got.values()):8d} {seconds:6.2f}s", flush=True)
            if not same:
                failures += 1
                print("   columns", sorted(df.columns), sorted(columns), "rows", sum(got.values()), sum(want.values()))
                print("   only here", list((got - want).items())[:3])
                print("   only there", list((want - got).items())[:3])
        except Exception as error:  # noqa: BLE001
            failures += 1
            print(f"FAIL  {name}: {str(error)[:1500]}", flush=True)
    print("failures:", failures)
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(*sys.argv[1:]) else 0)
