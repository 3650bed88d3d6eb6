"""Times headline queries; prints one JSON line.

Input tables derived from the star schema are written once before the clock starts, as tables at
rest would be; their time is reported as `inputs`. Each query is forced with a no-op write, so all
rows are produced but none reach the driver.
"""

from __future__ import annotations

import json
import os
import time

import octroi.catalog  # noqa: F401
from octroi.catalog import registry
from octroi.session import build_session
from octroi.sources.standins import AT_REST, Inputs

HEADLINE = [
    "zero_price_disposition", "disposition_tally", "coverage_by_operator", "asymmetry_audit", "corridor_summary",
    "resolve_blank_endpoints", "apply_rematch", "transfer_pairs", "colocated_aliases", "physical_clusters",
    "snap_to_road", "features_in_radius", "gates_on_route", "distance_checks", "gate_error_vote", "row_rejects",
    "error_percentiles", "isolation_summary", "gate_score", "edges_toll", "edges_free", "graph_stats", "edge_costs",
    "along_route_spacing", "route_sections", "segment_merge", "request_results",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), memory=os.environ.get("BENCH_MEMORY", "10g"))
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    x = Inputs(spark, folder)
    for name in AT_REST:
        x.table(name)
    inputs = time.time() - start
    run = registry.spark_queries()
    seconds = {}
    for key in only.split(",") if only else HEADLINE:
        t = time.time()
        run[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.time() - t, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "inputs": round(inputs, 3), "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
