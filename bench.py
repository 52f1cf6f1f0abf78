"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, best of two after a warm-up."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

HERE = Path(__file__)
sys.path.insert(0, str(HERE.resolve().parent))

from tessera import session  # noqa: E402
from tessera.plans import catalogue  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
HEADLINE = [f"tpch_q{i}" for i in range(1, 23)] + ["join_salted", "window_ranking", "window_running", "rollup", "set_intersect_all", "knn_l2"]


def main() -> None:
    spark = session.build(f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: catalogue.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    run("tpch_q1")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 4)
    total = round(sum(v for k, v in seconds.items() if k.startswith("tpch_")), 3)
    print(json.dumps({"metric": "tpch_22_suite", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
