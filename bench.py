"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8); names as arguments pick queries.
"""

import json
import os
import sys
import time

from landwatch import catalogue
from landwatch.session import local_session

HEADLINE = [
    "change_statistics", "change_regions", "change_polygons", "slope_and_aspect", "zone_terrain", "terrain_at_assets",
    "risk_level_counts", "nearby_assets_ranked", "risk_scores", "risk_factor_totals", "plan_events_by_level", "plan_events_near_hospitals",
    "area_statistics", "run_list", "terrain_products", "best_scene_per_area", "imagery_check", "event_load_outcome", "run_states",
    "way_features", "asset_kinds", "events_from_rasters",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, times = catalogue.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cores": cores}))


if __name__ == "__main__":
    main()
