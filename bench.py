"""Headline queries, timed once each after a warm-up; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated, optional).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "classify_category", "building_kind", "way_width_m", "project_utm", "point_in_ring",
    "points_in_footprint", "area_of_point", "only_missing", "neighbour_levels", "lot_overlaps", "conflict_pairs",
    "people_per_chunk", "spawn_value", "census_summary", "density_grid", "build_report", "dominant_angle", "vertex_degree",
    "cumulative_road_distance", "next_prev_cut", "control_to_junction", "control_near_segment", "junction_arms",
    "rasterize_polygon", "rasterize_line", "ground_cover", "erode_mask", "directional_nearest", "tile_runs", "kerb_candidates",
    "connected_tiles", "block_density", "fold_edits", "trailing_rate", "capped_layers", "top_landmarks", "placement_order",
    "scan_geojsonseq", "sink_feature_grid", "junction_clusters", "shape_filter", "assemble_rings",
]


def main() -> None:
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    from mapweft.plans import catalog
    from mapweft.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_type").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        try:
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
            print(f"{name} {times[name]}", file=sys.stderr, flush=True)
        except Exception as err:  # noqa: BLE001
            print(f"{name}: {str(err)[:300]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "failed": [n for n in names if n not in times], "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
