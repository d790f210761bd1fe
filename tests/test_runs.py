"""Owners, borders and lattices on runs against the same thing done tile by tile, and plans that broadcast no spread rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweft.operators import ground as GR
from mapweft.operators import joins as J
from mapweft.operators import painter as P
from mapweft.operators import tiles as R

SF = "/root/testdata/sf0.001"
# A join by tiles whose one side looks small because it is spread into tiles after its size is known.
SPREAD = re.compile(r"BroadcastHashJoin \[[tn][xy]#")


def some_boxes(seed, n=60):
    rng = random.Random(seed)
    return [(i, rng.randrange(-20, 90), rng.randrange(-5, 25), rng.randrange(1, 80 if i % 9 == 0 else 12), rng.randrange(1, 6)) for i in range(n)]


def frame(spark, boxes):
    return spark.createDataFrame(boxes, "fid long, x0 long, y0 long, w long, h long").repartition(3)


def tiles_of(boxes):
    return [((x, y), fid) for fid, x0, y0, w, h in boxes for x in range(x0, x0 + w) for y in range(y0, y0 + h)]


@pytest.mark.parametrize("last", [False, True])
@pytest.mark.parametrize("block", [4, 64])
def test_each_tile_has_one_owner(spark, block, last):
    boxes = some_boxes(1)
    want = {}
    for tile, fid in tiles_of(boxes):
        want[tile] = (max if last else min)(fid, want.get(tile, fid))
    got = {}
    for r in P.claimed(P.box_runs(frame(spark, boxes), ["fid"]), "fid", [], last, block).collect():
        for x in range(r.x0, r.x1):
            assert (x, r.ty) not in got
            got[x, r.ty] = r.fid
    assert got == want


def owners(boxes):
    own = {}
    for tile, fid in tiles_of(boxes):
        own[tile] = min(fid, own.get(tile, fid))
    return own


def test_walls_and_shared_edges(spark):
    boxes = some_boxes(2)
    own, walls, edges = owners(boxes), set(), {}
    for (x, y), fid in own.items():
        for nx, ny, side in ((x, y - 1, "N"), (x - 1, y, "W")):
            other = own.get((nx, ny), fid)
            if other != fid:
                walls |= {(fid, x, y, side, other % 7), (other, x, y, side, fid % 7)}
                pair = (min(fid, other), max(fid, other))
                edges[pair] = edges.get(pair, 0) + 1
    owned = P.claimed(P.box_runs(frame(spark, boxes).withColumn("levels", F.col("fid") % 7), ["fid", "levels"]), "fid", ["levels"])
    got = [(r.fid, r.x, r.y, r.side, r.storeys) for r in J.party_walls(owned).collect()]
    assert set(got) == walls and len(got) == len(walls)
    assert {(r.a, r.b): r.edges for r in R.region_adjacency(owned, "fid").collect()} == edges


def test_lattice_keeps_off_runs(spark):
    boxes, blocks = some_boxes(3, 12), some_boxes(4, 40)
    shut = {tile for tile, _ in tiles_of(blocks)}
    want = sorted((fid, x, y) for fid, x0, y0, w, h in boxes for x in range(x0, x0 + w, 3) for y in range(y0, y0 + h, 2) if (x, y) not in shut)
    got = GR.lattice_in_polygon(frame(spark, boxes), "fid", 3, 2, P.box_runs(frame(spark, blocks), []))
    assert sorted((r.fid, r.tx, r.ty) for r in got.collect()) == want


def test_weights_count_each_tile_once(spark):
    boxes = some_boxes(5, 25)
    runs = [(y, x, x + 8) for y in range(-5, 25, 2) for x in range(-20, 160, 5)]
    paved = {(x, y) for y, a, b in runs for x in range(a, b)}
    ground = spark.createDataFrame(runs, "ty long, x0 long, x1 long").withColumn("weight", F.lit(2))
    want = {fid: 2 * sum((x, y) in paved for x in range(x0, x0 + w) for y in range(y0, y0 + h)) for fid, x0, y0, w, h in boxes}
    assert {r.fid: r.weight for r in J.weight_under(frame(spark, boxes), ground).collect()} == want


@pytest.mark.parametrize("key", ["footprints_on_ground", "lattice_in_polygon", "party_walls", "region_adjacency"])
def test_spread_rows_are_not_broadcast(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not SPREAD.search(plan)


def test_grown_masks_and_edges(spark):
    boxes = some_boxes(6, 30)
    on = {tile for tile, _ in tiles_of(boxes)}
    for r in (1, 3):
        square = {(x + i, y + j) for x, y in on for i in range(-r, r + 1) for j in range(-r, r + 1)}
        diamond = {(x + i, y + j) for x, y in on for i in range(-r, r + 1) for j in range(-r, r + 1) if abs(i) + abs(j) <= r}
        for got, want in ((R.box_reach(frame(spark, boxes), r), square), (R.dilate_mask(frame(spark, boxes), r), diamond)):
            rows = [(t.tx, t.ty) for t in got.collect()]
            assert set(rows) == want and len(rows) == len(want)
    edges = {(x + (i if side == "W" else 0), y + (i if side == "N" else 0), side) for x, y in on for i in (0, 1) for side in "WN"}
    edges = {(x, y, side) for x, y, side in edges if ((x, y) in on) != ((x - (side == "W"), y - (side == "N")) in on)}
    got = [(r.x, r.y, r.side) for r in P.edges(P.box_runs(frame(spark, boxes), [])).collect()]
    assert set(got) == edges and len(got) == len(edges)


def test_retiled_runs_count_tiles(spark):
    runs = spark.createDataFrame([(0, 5, 20, 2), (0, 20, 40, 4), (9, 39, 41, 2)], "ty long, x0 long, x1 long, value int")
    got = {(r.cx, r.cy): (r.n_set, r.n_default, r.total) for r in R.retile(runs, "value", 10).collect()}
    assert got == {(0, 0): (5, 95, 10), (1, 0): (10, 90, 20), (2, 0): (10, 90, 40), (3, 0): (11, 89, 42), (4, 0): (1, 99, 2)}


def test_point_projected_as_column_pairs_are(spark):
    from mapweft.functions import project as U

    grid = U.build_grid(40.0, 20.0, 40.1, 20.1, 2.0, rotation=30.0)
    x, y = U.project_utm(F.col("lat"), F.col("lon"), grid)
    rows = spark.createDataFrame([(40.0 + i / 70, 20.1 - i / 90) for i in range(8)], "lat double, lon double")
    for r in rows.select(x.alias("x"), y.alias("y"), U.project_point(F.col("lat"), F.col("lon"), grid).alias("p")).collect():
        assert abs(r.x - r.p.x) < 1e-6 and abs(r.y - r.p.y) < 1e-6


@pytest.mark.parametrize("key", ["street_side", "limits", "shape_to_tiles", "box_reach", "dilate_mask", "boundary_edges", "rerun_equal"])
def test_boxes_are_dealt_out_before_they_are_spread(spark, key):
    plan = entry.queries()[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and not SPREAD.search(plan)
