"""Run registered queries and their SQL twins side by side: python -m tests.compare [DIR] [NAME...]."""

from __future__ import annotations

import glob
import hashlib
import math
import os
import sys
import time


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    """A value in the form in which both engines' results are compared."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return round(float(value), 9) if isinstance(value, float) else value


def digest(columns: list[str], rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    lines = sorted(repr([plain(r[i]) for i in order]) for r in rows)
    return len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest()


def compare(spark, con, sf_dir: str, run, sql: str) -> str:
    """Empty if the results agree, or what differs."""
    df = run(spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    other = con.execute(sql)
    names = [c[0] for c in other.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = other.fetchall()
    if digest(df.columns, mine) == digest(names, theirs):
        return ""
    a, b = ({repr([plain(r[names_.index(c)]) for c in sorted(names)]) for r in rows} for names_, rows in ((df.columns, mine), (names, theirs)))
    return f"{len(mine)} and {len(theirs)} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if n in sql]:
        began = time.time()
        try:
            said = compare(spark, con, sf_dir, queries[name], sql[name]) if name in sql else f"{queries[name](spark, sf_dir).count()} rows, no twin"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(said) and name in sql
        print(f"{name} {time.time() - began:.1f} s {said or 'ok'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
