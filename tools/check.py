"""Run registered queries next to their check statements and report differences.

usage: python tools/check.py [sf_dir] [@module ...] [name-part ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tallyweave.plans import catalog  # noqa: E402
from tallyweave.session import local_session  # noqa: E402
from tallyweave.sources.driver_views import TABLES  # noqa: E402


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if type(value).__name__ in ("NaTType", "NAType"):
        return "null"
    if isinstance(value, bool) or type(value).__name__ in ("bool_", "bool"):
        return str(bool(value))
    if isinstance(value, (int, float)) or type(value).__name__.startswith(("int", "float")):
        number = float(value)
        return f"{number:.0f}" if number.is_integer() else repr(number)
    return type(value).__name__ + ":" + str(value) if not isinstance(value, str) else value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in row) for row in frame.itertuples(index=False))


def main() -> int:
    arguments = sys.argv[1:]
    sf_dir = arguments.pop(0) if arguments and os.path.isdir(arguments[0]) else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    failed = 0
    modules = [a[1:] for a in arguments if a.startswith("@")]
    parts = [a for a in arguments if not a.startswith("@")]
    for name, run in catalog.QUERIES.items():
        wanted = catalog.MODULES[name] in modules or any(part in name for part in parts)
        if arguments and not wanted:
            continue
        started = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: spark: {str(error)[:1500]}", flush=True)
            continue
        took = time.time() - started
        if name not in catalog.ORACLES:
            print(f"rows {name}: {len(got)} rows, {took:.1f}s", flush=True)
            continue
        started = time.time()
        try:
            expected = connection.execute(catalog.ORACLES[name]).fetchdf()
        except Exception as error:  # noqa: BLE001
            failed += 1
            print(f"FAIL {name}: oracle: {str(error)[:1500]}", flush=True)
            continue
        oracle_took = time.time() - started
        if sorted(got.columns) != sorted(expected.columns):
            failed += 1
            print(f"FAIL {name}: columns {sorted(got.columns)} vs {sorted(expected.columns)}", flush=True)
            continue
        a, b = rows(got), rows(expected)
        if a != b:
            failed += 1
            only_a = sorted(set(a) - set(b))[:3]
            only_b = sorted(set(b) - set(a))[:3]
            print(f"FAIL {name}: {len(a)} vs {len(b)} rows\n  {sorted(got.columns)}", flush=True)
            for r in only_a:
                print("  spark ", r)
            for r in only_b:
                print("  oracle", r)
        else:
            print(f"ok   {name}: {len(a)} rows, {took:.1f}s (check {oracle_took:.1f}s)", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
