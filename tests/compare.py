"""Run queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

from lodestone.plans import ORACLES, PLANS
from lodestone.plans.registry import TABLE_NAMES
from lodestone.session import build_session


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def as_rows(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


SPARK_SECONDS: dict[str, float] = {}


def compare(spark, con, folder: str, name: str) -> str:
    """'' when equal, else what differs."""
    t0 = time.time()
    df = PLANS[name](spark, folder)
    columns, got = as_rows(df.columns, df.collect())
    SPARK_SECONDS[name] = time.time() - t0
    if name not in ORACLES:
        return "" if got else "no rows"
    cur = con.execute(ORACLES[name])
    want_columns, want = as_rows([d[0] for d in cur.description], cur.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if got != want:
        extra, lost = list((got - want).items())[:2], list((want - got).items())[:2]
        counts = f"{sum(got.values())} rows, expected {sum(want.values())}"
        return f"{counts}; extra {extra!s:.600} missing {lost!s:.600}"
    if not got:
        return "no rows on either side"
    return ""


def main() -> int:
    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    spark = build_session("compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", **quiet})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in sys.argv[1:] or list(PLANS):
        t0 = time.time()
        try:
            found = compare(spark, con, folder, name)
        except Exception as e:
            found = f"{type(e).__name__}: {e!s:.1500}"
        bad += bool(found)
        print(f"{'FAIL' if found else 'ok':4} {name:26} {time.time() - t0:6.1f}s (spark {SPARK_SECONDS.get(name, 0):.1f}s) {found}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
