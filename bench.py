"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local cores. Every query
runs once to warm up and then ``BENCH_RUNS`` times (default 2); the best time counts. All
result rows are computed and thrown away. A fixed job that reads no table is timed the same way,
and each query's time is also given as a multiple of it, to compare rounds on unlike machines.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import pyspark

from checks.queries import QUERIES
from fathomix.session import build_session

HEADLINES = (
    "timeseries_points",
    "profile_points",
    "trajectory_points",
    "region_points",
    "region_all_points",
    "dataset_profiles",
    "observed_coverage",
    "row_index_dense",
    "position_in_blocks",
    "thin_every_fifth",
    "subset_export",
    "subset_distinct",
    "resolved_requests",
    "flatten_observations",
    "catalog_index",
    "catalog_find",
    "search_preview",
    "facet_keywords",
    "server_summary",
    "described_bounds",
    "routed_turns",
)


def calibration(spark) -> None:
    """Hash, shuffle and add up a fixed number of numbers."""
    numbers = spark.range(20_000_000).selectExpr("id", "xxhash64(id) % 100000 AS k")
    numbers.groupBy("k").agg({"id": "sum"}).write.format("noop").mode("overwrite").save()


def best_of(runs: int, job) -> float:
    best = None
    for _ in range(runs + 1):
        start = time.perf_counter()
        job()
        taken = time.perf_counter() - start
        best = taken if best is None or taken < best else best
    return best


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        f"local[{cpus}]", cpus,
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="fathomix-bench-"), "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    unit = best_of(runs, lambda: calibration(spark))
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        best = best_of(runs, lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save())
        seconds[name] = round(best, 3)
        print(f"{name} {best:.3f}s", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "calibration": round(unit, 3),
        "multiples": {name: round(best / unit, 2) for name, best in seconds.items()},
        "sf": Path(folder).name.removeprefix("sf"),
        "spark": pyspark.__version__,
        "master": f"local[{cpus}]",
        "shuffle_partitions": cpus,
    }))


if __name__ == "__main__":
    main()
