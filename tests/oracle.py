"""Run registered queries against DuckDB on the same files and compare rows.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


inexact = 0


def canonical(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, decimal.Decimal)):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _key(row):
    return tuple(("" if v is None else f"{v:.5e}" if isinstance(v, float) else str(v)) for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols) -> str | None:
    """None when equal, else what differs."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(spark_cols)} vs {sorted(duck_cols)}"
    if len(spark_rows) != len(duck_rows):
        return f"rows {len(spark_rows)} vs {len(duck_rows)}"
    order = sorted(spark_cols)
    global inexact
    inexact = 0
    left = sorted([[canonical(r[spark_cols.index(c)]) for c in order] for r in spark_rows], key=_key)
    right = sorted([[canonical(r[duck_cols.index(c)]) for c in order] for r in duck_rows], key=_key)
    for a, b in zip(left, right):
        for c, x, y in zip(order, a, b):
            same = x == y or (isinstance(x, float) and isinstance(y, float)
                              and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
            inexact += same and x != y
            if not same:
                return f"{c}: {x!r} vs {y!r} in {dict(zip(order, a))}"
    return None


def session():
    from packetloom.session import build_session
    spark = build_session("oracle", "local[8]", {
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "8g", "spark.sql.ansi.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    from packetloom.plans.catalogue import load_all
    spark, con = session(), connect(sf_dir)
    failed = 0
    for name, item in load_all().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = item.build(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            note = f"{len(rows)} rows {time.time() - start:.2f}s"
            if item.sql:
                result = con.execute(item.sql)
                cols = [d[0] for d in result.description]
                problem = compare(rows, df.columns, result.fetchall(), cols)
                note += f" ~{inexact} values differ in the last digits" if inexact else ""
            else:
                problem, note = None, note + " (no sql)"
            if not rows:
                note += " EMPTY"
        except Exception as exc:  # report and go on with the next query
            problem, note = f"{type(exc).__name__}: {str(exc)[:1500]}", ""
        failed += problem is not None
        print(("FAIL " if problem else "ok   ") + name, problem or note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
