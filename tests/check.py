"""Compare every registered query with its DuckDB text: python -m tests.check [folder] [name prefixes…]."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from cratewise.queries.roles import BASE_TABLES
from tests.compare import difference


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g").config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    runs, texts = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in runs.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in texts:
                found = difference(df, con.execute(texts[name]))
                rows = df.count()
                verdict = found or f"ok {rows} rows"
            else:
                found, verdict = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            found = verdict = f"{type(e).__name__} {str(e)[:700]}"
        bad += bool(found)
        print(f"{'FAIL' if found else '    '} {name} {time.time() - start:.1f}s {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001", sys.argv[2:]) > 0)
