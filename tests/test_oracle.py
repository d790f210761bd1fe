"""A spread of registered queries beside their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from mapweft.plans.views import TABLES
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
KEYS = ["classify_category", "building_kind", "use_of_tags", "biome_of_feature", "parse_measure", "project_utm", "point_in_ring",
        "points_in_footprint", "area_of_point", "only_missing", "gap_semi", "neighbour_levels", "lot_overlaps", "people_per_chunk",
        "census_summary", "density_grid", "build_report", "vertex_degree", "next_prev_cut", "control_to_junction", "tile_runs",
        "erode_mask", "rasterize_polygon", "kerb_candidates", "fold_edits", "stale_stages", "capped_layers", "fit_pieces",
        "scan_geojsonseq", "sink_feature_grid", "junction_kind", "row_units", "zone_override", "seed_nudge", "within_distance_anti",
        "first_by_area", "fill_from", "shape_filter", "rasterize_line", "ground_cover", "biome_cover", "woodland_grade", "clip_cover_to_shape",
        "parking_zones", "junction_clusters", "junction_controls", "dismiss_under_bridges", "crossing_between_junctions", "assemble_rings",
        "tag_rules", "limits", "distinct_uses_limit", "trailing_rate_stream", "redact_user", "error_text"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, duck, key):
    got = entry.queries()[key](spark, SF).toArrow()
    want = duck.sql(entry.oracle_sql()[key]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
