"""Run catalogue queries against their SQL counterpart: python -m tests.compare [sf] [name-part …]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from panelcast.plans.catalogue import ORACLE, QUERIES
from panelcast.session import build_session

TESTDATA = "/root/testdata"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# Spark type -> type name of the other engine.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "timestamp": "TIMESTAMP",
}


def local_session(cores: int = 8) -> SparkSession:
    return build_session(
        "panelcast-local",
        **{
            "spark.master": f"local[{cores}]", "spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "8g",
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.codegen.cache.maxEntries": "1000",
        },
    )


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value) -> str:
    if isinstance(value, float) and math.isnan(value):
        return "None"
    return repr(float(value)) if isinstance(value, float) else str(value)


def difference(spark: SparkSession, con, name: str, sf_dir: str) -> str | None:
    """None when rows, columns and types agree, else a description."""
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        return None
    rel = con.sql(ORACLE[name])
    got_types = {c: TYPES.get(t, t) for c, t in df.dtypes}
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    if got_types != want_types:
        return f"schema {got_types} vs {want_types}"
    order = sorted(df.columns)
    got = sorted(tuple(cell(r[df.columns.index(c)]) for c in order) for r in rows)
    want = sorted(tuple(cell(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())
    if got == want:
        return None
    a, b = set(got) - set(want), set(want) - set(got)
    return f"{len(got)} vs {len(want)} rows, {len(a)} only here {sorted(a)[:2]}, {len(b)} only there {sorted(b)[:2]}"


def main() -> None:
    sf, parts = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in QUERIES:
        if parts and not any(p in name for p in parts):
            continue
        started = time.perf_counter()
        try:
            problem = difference(spark, con, name, sf_dir)
        except Exception as err:
            problem = f"{type(err).__name__}: {str(err)[:1500]}"
        bad += problem is not None
        print(f"{name:24s} {time.perf_counter() - started:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
