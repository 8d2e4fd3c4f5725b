"""Compare registered queries with their SQL twins.

As a script: ``python tests/oracle_check.py [sf_dir] [query ...]``.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def normalise(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    """Empty when rows and column names agree."""
    got = normalise(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = normalise(names, cursor.fetchall())
    found = []
    if sorted(names) != sorted(df.columns):
        found.append(f"columns {sorted(df.columns)} against {sorted(names)}")
    if len(got) != len(want):
        found.append(f"rows {len(got)} against {len(want)}")
    uneven = [(g, w) for g, w in zip(got, want) if g != w]
    found += [f"{g}\n   against {w}" for g, w in uneven[:limit]]
    if uneven:
        found.append(f"{len(uneven)} rows differ")
    return found


def main() -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    # a session without this package's settings, as others may bring
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
    spark = builder.config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(sf_dir), entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = []
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf_dir)
            if name in sql:
                found = differences(df, con, sql[name])
                verdict = "equal" if not found else "DIFFERS\n  " + "\n  ".join(found)
            else:
                found, verdict = [], f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            found, verdict = [str(error)], f"FAILS {str(error)[:1200]}"
        if found:
            bad.append(name)
        print(f"{name:24s} {time.time() - start:6.2f}s {verdict}"[:2500], flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} fine; not fine: {bad}")


if __name__ == "__main__":
    main()
