
from __future__ import annotations

import datetime
import os
import statistics
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).parent))

import bench  # noqa: E402
from sparrowmill.plans.registry import ORACLES  # noqa: E402
from sparrowmill.session import local_session  # noqa: E402

RUNS = 3


def main() -> None:
    spark = local_session(bench.CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; SET threads = {bench.CPUS}")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{bench.SF_DIR}/{name}.parquet'")
    config = f"{bench.SF_DIR.rsplit('/', 1)[-1]}, {bench.CPUS} cores, {os.sysconf('SC_PAGE_SIZE') * os.sysconf('SC_PHYS_PAGES') >> 30} GiB, {spark.conf.get('spark.sql.shuffle.partitions')} shuffle partitions, AQE on"

    def ducked(name: str) -> float:
        began = time.perf_counter()
        con.execute(ORACLES[name]).arrow()
        return time.perf_counter() - began

    for name in bench.HEADLINE:
        medians = []
        for run in (lambda: bench.seconds(spark, name), lambda: ducked(name)):
            run()
            medians.append(statistics.median(run() for _ in range(RUNS)))
        print(f"| {name} | {medians[0]:.3f} | {medians[1]:.3f} | {config} | {datetime.date.today()} |", flush=True)


if __name__ == "__main__":
    main()
