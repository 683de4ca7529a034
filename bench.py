"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then $BENCH_RUNS times; the median counts. BENCH_ORACLE=1 also times the
same SQL in DuckDB, as the yardstick on the same machine.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    import matrixloom.queries as core

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", "/tmp/matrixloom-bench/warehouse")
        .config("spark.checkpoint.dir", "/tmp/matrixloom-bench/checkpoint")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sorted(core.QUERIES) if not os.environ.get("BENCH_QUERIES") else os.environ["BENCH_QUERIES"].split(",")

    def once(name: str) -> float:
        start = time.perf_counter()
        core.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    line = {"metric": "total_warm_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
    if os.environ.get("BENCH_ORACLE"):
        import duckdb

        con = duckdb.connect()
        for t in "region nation customer supplier part orders lineitem events embeddings".split():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        line["oracle"] = {}
        for name in names:
            start = time.perf_counter()
            con.execute(core.ORACLE_SQL[name]).fetchall()
            line["oracle"][name] = round(time.perf_counter() - start, 3)
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
