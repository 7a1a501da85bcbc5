"""Compare every query with its SQL:  python -m parity.check SF_DIR [name part ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def difference(spark_table, sql_table) -> str | None:
    """None if both Arrow tables hold the same names, types and rows in any order."""
    types = [{f.name: str(f.type).replace("large_string", "string") for f in t.schema} for t in (spark_table, sql_table)]
    if types[0] != types[1]:
        return f"schema {types[0]} against {types[1]}"
    if spark_table.num_rows != sql_table.num_rows:
        return f"rows {spark_table.num_rows} against {sql_table.num_rows}"
    names = sorted(types[0])
    rows = [sorted(map(repr, zip(*[t.column(n).to_pylist() for n in names]))) for t in (spark_table, sql_table)]
    wrong = [(a, b) for a, b in zip(*rows) if a != b]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else None


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    from parity.all_cases import CASES
    from parity.registry import run

    sf_dir, wanted = argv[0], argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf_dir)
    failed = 0
    for name, one in CASES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = run(name, spark, sf_dir).toArrow()
            spent = time.time() - start
            if one.sql is None:
                verdict = None
            else:
                expected = con.execute(one.sql).to_arrow_table()
                verdict = difference(got, expected)
            note = f"{got.num_rows} rows, {spent:.1f} s" + (" (no SQL)" if one.sql is None else "")
        except Exception:  # a broken query must not hide the others
            verdict, note = traceback.format_exc(limit=-2)[-900:], ""
        failed += verdict is not None
        print(f"{'ok  ' if verdict is None else 'FAIL'} {name} {note} {verdict or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
