"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from sparrowmill.plans.registry import QUERIES  # noqa: E402
from sparrowmill.session import local_session  # noqa: E402

SF_DIR, CPUS, RUNS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8")), 3
HEADLINE = [f"tpch_q{i:02d}" for i in range(1, 23)] + ["ssb_flight_1", "ssb_flight_2", "ssb_flight_3", "ssb_flight_4", "many_joins", "agg_all_functions", "window_running", "set_except_all", "top_k"]


def seconds(spark, name: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        seconds(spark, name)
        took[name] = round(statistics.median(seconds(spark, name) for _ in range(RUNS)), 4)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1], "cores": CPUS}))


if __name__ == "__main__":
    main()
