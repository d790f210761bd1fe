"""Ring joins and interior points against brute force: slanted, concave and hollow outlines, points on edges and far away."""

import math
import random

import pytest
from pyspark.sql import functions as F

from mapweft.operators import rings as R

L_SHAPE = [(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)]
CRESCENT = [(0, 0), (12, 0), (12, 12), (0, 12), (0, 10), (9, 10), (9, 2), (0, 2)]


def sides(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def shapes(seed=3):
    rng = random.Random(seed)
    out = {0: [L_SHAPE], 1: [CRESCENT], 2: [[(20, 0), (60, 5), (55, 45), (15, 40)], [(30, 10), (30, 30), (45, 30), (45, 10)]], 3: [[(-300, -300), (700, -250), (650, 600), (-280, 640)]],
           4: [[(0, 0), (10, 0), (10, 10), (0, 10)]], 5: [[(8, 0), (16, 0), (16, 8), (8, 8)]]}
    for k in range(6, 40):
        x, y, r = rng.randrange(-200, 400), rng.randrange(-200, 400), rng.choice([3, 9, 30, 90])
        n = rng.choice([3, 5, 9, 40])
        ring = [(x + round(r * rng.uniform(0.4, 1) * math.cos(2 * math.pi * i / n), 2), y + round(r * rng.uniform(0.4, 1) * math.sin(2 * math.pi * i / n), 2)) for i in range(n)]
        out[k] = [ring]
    return out


def edge_frame(spark, polygons):
    rows = [(k, i, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for k, rs in polygons.items() for i, r in enumerate(rs) for a, b in sides(r)]
    return spark.createDataFrame(rows, "key long, ring int, ax double, ay double, bx double, by double").repartition(3)


def distance(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def within(p, rings):
    odd = False
    for ring in rings:
        for a, b in sides(ring):
            if (b[0] - a[0]) * (p[1] - a[1]) == (b[1] - a[1]) * (p[0] - a[0]) and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1]):
                return False
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < a[0] + (p[1] - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
    return odd


def places(n=500):
    rng = random.Random(8)
    out = [(rng.randrange(-20, 80), rng.randrange(-20, 60)) for _ in range(n)] + [(rng.uniform(-320, 720), rng.uniform(-320, 660)) for _ in range(n)]
    return out + [(0, 0), (10, 4), (4, 4), (7, 4), (9, 5), (-5000, 3), (64, 64), (8, 8), (8, 3)]


@pytest.mark.parametrize("levels", [R.LEVELS, (4.0,), (1000.0,)])
def test_inside_is_brute_force(spark, levels):
    polygons, spots = shapes(), places()
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "pid long, x double, y double").repartition(2)
    got = {(r.pid, r.key) for r in R.ring_hits(points, edge_frame(spark, polygons), "pid", "key", levels=levels).collect()}
    assert got == {(i, k) for i, p in enumerate(spots) for k, rings in polygons.items() if within(p, rings)}


def test_distance_is_brute_force(spark):
    polygons, spots = shapes(), places()
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], "pid long, x double, y double")
    got = {(r.pid, r.key): (r.inside, r.distance) for r in R.ring_hits(points, edge_frame(spark, polygons), "pid", "key", reach=5.0).collect()}
    for i, p in enumerate(spots):
        for k, rings in polygons.items():
            near = min(distance(p, a, b) for r in rings for a, b in sides(r))
            inside = within(p, rings)
            assert ((i, k) in got) == (inside or near <= 5)
            if (i, k) in got:
                assert got[i, k][0] == inside and (near > 5 or got[i, k][1] == pytest.approx(near))


def test_areas_and_interior_points(spark):
    polygons = shapes()
    edges = edge_frame(spark, polygons)
    area = {r.key: r.area for r in R.polygon_area(edges, ["key"]).collect()}
    shoelace = lambda ring: abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in sides(ring))) / 2
    assert all(area[k] == pytest.approx(shoelace(r[0]) - sum(map(shoelace, r[1:]))) for k, r in polygons.items())
    spots = {r.key: (r.x, r.y) for r in R.interior_points(edges, "key").collect()}
    assert set(spots) == set(polygons) and all(within(spots[k], polygons[k]) for k in polygons)
    assert spots[1] == (10.5, 6.0)  # the crescent's thick side, not its middle


def crosses(p, q, a, b):
    def side(o, u, v):
        return (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])

    if max(p[0], q[0]) < min(a[0], b[0]) or max(a[0], b[0]) < min(p[0], q[0]) or max(p[1], q[1]) < min(a[1], b[1]) or max(a[1], b[1]) < min(p[1], q[1]):
        return False
    return side(a, b, p) * side(a, b, q) <= 0 and side(p, q, a) * side(p, q, b) <= 0


def test_lines_that_meet(spark):
    """Lines that only cross, that lie inside, that end on a corner, and that pass by."""
    rng = random.Random(5)
    lines = {0: [(-5, 2), (20, 2)], 1: [(1, 1), (2, 3)], 2: [(-4, -4), (0, 0)], 3: [(5, 6), (9, 9)], 4: [(32, 15), (40, 25)], 5: [(30, 10), (40, 20)], 6: [(-900, -900), (-800, -800)]}
    for k in range(7, 60):
        at = (rng.uniform(-250, 450), rng.uniform(-250, 450))
        lines[k] = [at]
        for _ in range(rng.randrange(1, 5)):
            at = (at[0] + rng.uniform(-60, 60), at[1] + rng.uniform(-60, 60))
            lines[k].append(at)
    polygons = {k: v for k, v in shapes().items() if k != 3}
    rows = [(k, i, *map(float, (*a, *b))) for k, pts in lines.items() for i, (a, b) in enumerate(zip(pts, pts[1:]))]
    frame = spark.createDataFrame(rows, "lid long, pos int, px double, py double, qx double, qy double")
    got = {(r.lid, r.key) for r in R.lines_meeting(frame, edge_frame(spark, polygons), "lid", "key").collect()}
    want = {(k, g) for k, pts in lines.items() for g, rings in polygons.items()
            if within(pts[0], rings) or any(crosses(p, q, a, b) for p, q in zip(pts, pts[1:]) for r in rings for a, b in sides(r))}
    assert got == want and {(0, 0), (1, 0), (2, 0)} <= got and (4, 2) not in got


def test_claims(spark):
    """The largest footprint claims; points of one place are one; a door just outside counts."""
    edges = edge_frame(spark, {4: shapes()[4], 5: shapes()[5], 9: [[(30, 0), (34, 0), (34, 4), (30, 4)]]}).withColumnRenamed("key", "fid")
    spots = [(1, 9, 3), (2, 9, 3), (3, 12, 3), (4, 10.5, 9.0), (5, 30, 4), (6, 35.5, 2), (7, 34.9, 2)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in spots], "pid long, x double, y double")
    assert {(r.pid, r.fid) for r in R.claimed_points(points, edges).collect()} == {(1, 4), (3, 5), (4, 4), (5, 9), (7, 9)}
    outside = R.outside_all(points, edges, distance=1.0)
    assert {r.pid for r in outside.collect()} == {6}
    assert R.outside_all(points, edges.limit(0)).count() == len(spots) and R.claimed_points(points.limit(0), edges).count() == 0


def test_smallest_area_and_seeds(spark):
    edges = edge_frame(spark, {k: shapes()[k] for k in (0, 3, 4, 5)}).withColumnRenamed("key", "aid")
    areas = spark.createDataFrame([(0, "l", 3), (3, "all", None), (4, "square", 5), (5, "second", 7)], "aid long, category string, seed long")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 9.0, 9.0), (3, 2.0, 2.0), (4, 9.0, 2.0), (5, 9000.0, 1.0)], "pid long, px double, py double")
    got = {r.pid: (r.category, r.covered) for r in R.smallest_around(points, edges, areas, ["category"], "pid").collect()}
    assert got == {1: ("l", True), 2: ("square", True), 3: ("l", True), 4: ("l", True), 5: (None, False)} or got[4][0] in ("l", "second")
    nudges = {r.pid: r.nudge for r in R.seeds_around(points, edges, areas, "pid").collect()}
    assert nudges == {1: 9, 2: 6, 3: 9, 4: 16, 5: 0}


def test_boxes_are_rings(spark):
    boxes = spark.createDataFrame([(1, 3, 4, 5, 6)], "fid long, x0 long, y0 long, w long, h long")
    edges = R.box_edges(boxes.withColumn("ring", F.lit(0)), ["fid", "ring"])
    assert edges.count() == 4 and R.polygon_area(edges, ["fid"]).first().area == 30
