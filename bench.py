"""Bench: run the headline catalogue queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print ONE JSON line.

Each query is fully executed with the ``noop`` sink (whole plan, nothing collected to the
driver). The CSV trees the Stage-1/2 queries read are written once beforehand and timed
separately (``fixture_*``), so query times cover reading + computing only. ``session_staging`` is the
one parse of the session tree that the session queries share; it counts as a query.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "linear_fit", "unique_values", "value_mode", "value_jumps", "peak_location", "curve_areas",
    "early_cycle_stats", "early_cycle_stats_short", "peak_candidates", "peak_detection",
    "session_scan", "session_features", "session_timeline", "feature_timeline", "design_matrix",
    "regression_metrics", "loo_folds", "loocv_predictions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from ampfold.catalog import QUERIES, fixtures
    from ampfold.session import local_session, remove_scratch

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="ampfold-bench")
    times: dict[str, float] = {}

    t0 = time.perf_counter()
    fixtures.session_tree(spark, sf_dir)
    times["fixture_session_tree"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    fixtures.cycle_tree(spark, sf_dir)
    times["fixture_cycle_tree"] = round(time.perf_counter() - t0, 3)

    queries: dict[str, float] = {}
    t0 = time.perf_counter()
    fixtures.open_sessions(spark, sf_dir)
    queries["session_staging"] = round(time.perf_counter() - t0, 3)
    for name in only:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - t0, 3)

    total = round(sum(queries.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1] if "sf" in sf_dir else sf_dir
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": queries,
                      "fixtures": times, "sf": sf, "cpus": cpus}))
    remove_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
