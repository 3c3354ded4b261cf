"""Run registered queries next to their SQL in DuckDB and compare the rows.

    python tests/oracle.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return repr(round(value, 6) + 0.0) if value != int(value) else repr(int(value))
    return repr(value) if not isinstance(value, str) else value


def compare(spark, con, sf: str, build, sql: str | None):
    """(problem or None, row count, seconds)."""
    start = time.time()
    df = build(spark, sf)
    rows = df.collect()
    took = time.time() - start
    if sql is None:
        return None, len(rows), took
    names = sorted(df.columns)
    got = sorted(tuple(plain(row[n]) for n in names) for row in rows)
    result = con.execute(sql)
    have = [d[0] for d in result.description]
    if sorted(have) != names:
        return f"columns {names} against {sorted(have)}", len(rows), took
    order = [have.index(n) for n in names]
    want = sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    if got != want:
        extra, missing = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}", len(rows), took
    return None, len(rows), took


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from gleanwork.session import builder

    from pyspark.sql import SparkSession

    sf, names = sys.argv[1], sys.argv[2:]
    # PLAIN=1 takes a session without this package's settings, as a caller might.
    start = SparkSession.builder if os.environ.get("PLAIN") else builder("oracle")
    spark = (
        start.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from gleanwork.queries import ORACLES, QUERIES

    con, bad = connect(sf), 0
    for name, build in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            problem, count, took = compare(spark, con, sf, build, ORACLES.get(name))
        except Exception as error:
            problem, count, took = f"{type(error).__name__}: {str(error)[-700:]}", -1, 0.0
        bad += problem is not None
        status = "ok  " if problem is None else "BAD "
        print(f"{status}{name:28s} {count:8d} rows {took:6.2f}s {'' if name in ORACLES else 'no sql'} {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
