"""Run registered queries against their SQL in DuckDB: ``python check.py [scale] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from poolscout.catalog import REGISTRY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value + 0.0, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:] or list(REGISTRY)
    folder = f"/root/testdata/sf{scale}"
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    duck = duckdb.connect()
    for table in TABLES.split():
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in wanted:
        query = REGISTRY[name]
        start = time.time()
        try:
            frame = query(spark, folder)
            got = [tuple(r) for r in frame.collect()]
            took = time.time() - start
            note = f"{len(got)} rows, rows only"
            if query.sql is not None:
                start = time.time()
                result = duck.execute(query.sql)
                names = [d[0] for d in result.description]
                types = {d[0]: str(d[1]) for d in result.description}
                want = rows_of(names, result.fetchall())
                sql_took = time.time() - start
                have = rows_of(frame.columns, got)
                if sorted(names) != sorted(frame.columns):
                    raise AssertionError(f"columns {frame.columns} against {names}")
                if have != want:
                    pairs = [(a, b) for a, b in zip(have, want) if a != b]
                    raise AssertionError(f"{len(have)} against {len(want)} rows, {len(pairs)} differ, first {pairs[:2]}")
                odd = {c: (t, types[c]) for c, t in frame.dtypes if (t, types[c]) not in SAME}
                note = f"{len(got)} rows, equal (SQL {sql_took:.2f}s){' TYPES ' + str(odd) if odd else ''}"
            print(f"ok   {name}: {took:.2f}s, {note}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            text = str(error).split("JVM stacktrace")[0][:900]
            print(f"FAIL {name}: {type(error).__name__} {text}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()
    print(f"{len(wanted) - bad} of {len(wanted)} passed")
    return bad


SAME = {
    ("bigint", "BIGINT"), ("int", "INTEGER"), ("double", "DOUBLE"), ("string", "VARCHAR"), ("boolean", "BOOLEAN"),
}

if __name__ == "__main__":
    raise SystemExit(main())
