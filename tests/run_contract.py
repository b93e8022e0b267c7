"""Compare every registered query with its SQL counterpart: python -m tests.run_contract [sf_dir] [names]."""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

import __spark_entry__ as contract
from tests.compare import differences, duck


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, oracles, failed = duck(sf_dir), contract.oracle_sql(), 0
    chosen = sys.argv[2:] or list(contract.queries())
    for name in chosen:
        started = time.time()
        try:
            df = contract.queries()[name](spark, sf_dir).cache()
            problem = differences(df, connection, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as failure:  # noqa: BLE001 - report and go on
            problem = f"{type(failure).__name__}: {str(failure)[:600]}"
        failed += problem is not None
        print(f"{name:42s} {time.time() - started:6.2f}s {problem or 'ok'} ({df.count()} rows)", flush=True)
        df.unpersist()
    print(f"{len(chosen) - failed} of {len(chosen)} agree; without SQL: {sorted(set(chosen) - oracles.keys())}")
    return failed


if __name__ == "__main__":
    sys.exit(main())
