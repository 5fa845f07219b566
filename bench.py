"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR is the data folder (default /root/testdata/sf0.1), BENCH_CPUS the
number of local cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from codeloom.plans.fixture import facts, index
from codeloom.plans.queries import QUERIES

#: The nine project checks, then set-at-a-time lookups for all symbols or files.
HEADLINE = (
    "cycles_two_way", "unreferenced", "dead_exports", "stale_types", "same_file_only", "test_only", "top_coupling", "bottlenecks", "hotspots",
    "members", "importers", "deps_symbol", "deps_file", "file_symbols", "search", "resolve_symbol", "def_context", "change_surface",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    for table in index(spark, sf_dir).tables().values():
        table.count()
    found = facts(spark, sf_dir)
    for name in ("use", "defs", "defuse", "live_modules", "live_aliases"):
        getattr(found, name).count()
    load = time.time() - began
    times = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        runs = []
        for _ in range(3):
            at = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - at)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "code_graph_queries_total", "value": total, "unit": "sec", "queries": times, "load_sec": round(load, 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
