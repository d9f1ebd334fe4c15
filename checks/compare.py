"""Run queries on Spark and on DuckDB and compare all rows and values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def local_session(cpus: int = 8, memory: str = "12g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tandem")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as db:
        for name in TABLES:
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
        cursor = db.execute(sql)
        return [c[0] for c in cursor.description], cursor.fetchall()


def _sorted_rows(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, str(v)) for v in row))


def differences(
    columns: list[str], rows: list[tuple], other_columns: list[str], other_rows: list[tuple]
) -> list[str]:
    """What differs, at most a few lines of it; empty if all is equal."""
    if sorted(columns) != sorted(other_columns):
        return [f"columns {sorted(columns)} against {sorted(other_columns)}"]
    if len(rows) != len(other_rows):
        return [f"{len(rows)} rows against {len(other_rows)}"]
    found = []
    for a, b in zip(_sorted_rows(columns, rows), _sorted_rows(other_columns, other_rows)):
        for x, y in zip(a, b):
            if isinstance(x, bool) != isinstance(y, bool) or (
                x != y
                and not (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y))
            ):
                found.append(f"{str(a)[:200]} against {str(b)[:200]}")
                break
        if len(found) == 3:
            break
    return found


def compare(spark: SparkSession, sf_dir: str, query, sql: str) -> list[str]:
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    return differences(df.columns, rows, *oracle_rows(sf_dir, sql))


def main(argv: list[str]) -> int:
    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in names:
        start = time.time()
        try:
            problems = (
                compare(spark, sf_dir, QUERIES[name], ORACLE[name])
                if name in ORACLE
                else [f"no SQL; {QUERIES[name](spark, sf_dir).count()} rows"]
            )
        except Exception as error:
            problems = [f"{type(error).__name__}: {str(error)[:1500]}"]
        failed += bool(problems)
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {time.time() - start:.1f}s", flush=True)
        for line in problems:
            print("     ", line)
    print(f"{len(names) - failed} of {len(names)} equal")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
