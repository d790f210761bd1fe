"""Operators decided in rounds or in blocks, against sequential brute force on seeded data."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweft.functions import tables as V
from mapweft.operators import footprints, graph, greedy, ground, joins, network, scan, tiles
from mapweft.operators.bucket import bucket_join, point


def ids(df, col="id"):
    return sorted(r[0] for r in df.select(col).collect())


@pytest.mark.parametrize("metric", ["axis", "euclid"])
def test_spaced_points(spark, metric):
    rng = np.random.default_rng(3)
    pts = [(i, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 60, (150, 2)))] + [(500 + i, 500 + i, 30.0, 30.0) for i in range(40)]
    kept = []
    for i, _r, x, y in pts:
        near = (lambda a, b: abs(a - x) < 7 and abs(b - y) < 7) if metric == "axis" else (lambda a, b: (a - x) ** 2 + (b - y) ** 2 < 49)
        if not any(near(a, b) for _i, a, b in kept):
            kept.append((i, x, y))
    df = spark.createDataFrame(pts, "id long, rank long, x double, y double")
    assert ids(greedy.spaced_points(df, 7.0, metric=metric)) == sorted(k[0] for k in kept)


def test_first_come(spark):
    rng = np.random.default_rng(5)
    edges = sorted({tuple(sorted(map(int, e))) for e in rng.integers(0, 40, (60, 2)) if e[0] != e[1]})
    kept = set()
    for i in range(45):
        if not any((a in kept and b == i) for a, b in edges):
            kept.add(i)
    items = spark.range(45)
    assert ids(greedy.first_come(items, spark.createDataFrame(edges, "better long, worse long"))) == sorted(kept)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 103), (200, 200)]
    got = dict(graph.connected_components(spark.createDataFrame(chain, "src long, dst long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 103, 105)} == {100} and got[200] == 200


def clusters_by_hand(rows, near=12.0):
    pairs = []
    for i, (a, ax, ay, aw, _l) in enumerate(rows):
        for b, bx, by, bw, _m in rows[i + 1:]:
            d = round(math.hypot(ax - bx, ay - by), 6)
            if d <= max(near, aw + bw):
                pairs.append((d, *sorted((a, b))))
    at = {r[0]: r for r in rows}
    owner, members = {r[0]: r[0] for r in rows}, {r[0]: [r[0]] for r in rows}
    for _d, a, b in sorted(pairs):
        p, q = owner[a], owner[b]
        if p == q:
            continue
        lim = max(near, at[a][3] + at[b][3])
        if any(round(math.hypot(at[x][1] - at[y][1], at[x][2] - at[y][2]), 6) > max(near, at[x][3] + at[y][3], lim) for x in members[p] for y in members[q]):
            continue
        lo, hi = min(p, q), max(p, q)
        members[lo] += members.pop(hi)
        for m in members[lo]:
            owner[m] = lo
    return owner


def test_junction_clusters(spark):
    rng = np.random.default_rng(11)
    rows = [(i, float(x), float(y), float(rng.choice([3.5, 6.0, 8.0, 12.0])), 3) for i, (x, y) in enumerate(rng.integers(0, 40, (12, 2)))]
    df = spark.createDataFrame(rows, "vkey long, x double, y double, width double, links long")
    got = dict(network.junction_clusters(df).collect())
    assert got == clusters_by_hand(rows)


def test_thin_and_grow(spark):
    rng = np.random.default_rng(7)
    kinds = ["house", "shed", "school", "apartment", "shop"]
    rows = [(i, float(x), float(y), int(rng.integers(20, 200)), int(rng.integers(5, 20)), kinds[i % 5]) for i, (x, y) in enumerate(rng.uniform(0, 90, (24, 2)))]
    kept, expect = [], {}
    for i, x, y, area, long_side, kind in sorted(rows, key=lambda r: (r[5] in V.HOUSING, -r[3], r[0])):
        land = kind not in V.HOUSING
        w = math.sqrt(max(1, area))
        target, ceiling = (V.LANDMARK_TILES[kind], 2.6) if land else (V.HOUSE_TILES, 1.9)
        want = 1.0 if area >= target else min(ceiling, math.sqrt(target / area), max(1.0, 60 / long_side))
        if not land and any((x - a) ** 2 + (y - b) ** 2 < (1.55 * (w + ow) / 2) ** 2 for a, b, ow in kept):
            expect[i] = (False, 1.0)
            continue
        for a, b, ow in kept:
            gap = math.dist((x, y), (a, b)) - ow / 2
            want = 1.0 if gap <= 0 else min(want, 2 * gap / max(1.0, w))
            if gap <= 0:
                break
        want = max(1.0, want)
        kept.append((x, y, w * want))
        expect[i] = (True, round(want, 6))
    df = spark.createDataFrame(rows, "id long, x double, y double, area long, long_side long, kind string")
    got = {r.id: (r.kept, round(r.factor, 6)) for r in network.thin_and_grow(df).collect()}
    assert got == expect


def test_place_footprints_never_overlap(spark):
    rng = np.random.default_rng(13)
    rows = [(i, int(x), int(y), int(w), int(h)) for i, (x, y, w, h) in enumerate(zip(rng.integers(0, 100, 60), rng.integers(0, 100, 60), rng.integers(3, 25, 60), rng.integers(3, 20, 60)))]
    out = network.place_footprints(spark.createDataFrame(rows, "fid long, x0 long, y0 long, w long, h long")).collect()
    assert len(out) == 60
    seen = set()
    for r in out:
        if r.outcome in ("placed", "yielded"):
            own = {(x, y) for x in range(r.x0, r.x0 + r.w) for y in range(r.y0, r.y0 + r.h)}
            assert len(own) >= 16 and not own & seen
            seen |= own


def test_connected_tiles_match_flood_fill(spark):
    rng = np.random.default_rng(17)
    on = {(int(x), int(y)) for x, y in rng.integers(0, 40, (700, 2))}
    left, sizes = set(on), []
    while left:
        stack, n = [left.pop()], 0
        while stack:
            x, y = stack.pop()
            n += 1
            for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if p in left:
                    left.remove(p)
                    stack.append(p)
        sizes.append(n)
    df = spark.createDataFrame(sorted(on), "tx long, ty long")
    assert sorted(r.tiles for r in ground.connected_tiles(df).collect()) == sorted(sizes)


def test_blocks_equal_plain_windows(spark):
    rng = np.random.default_rng(19)
    rows = [(g, i, float(rng.integers(0, 9)), int(i) if rng.random() < 0.2 else None) for g in range(3) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, pos long, v double, mark long")
    plain = scan.prefix_sum(df, ["g"], "pos", F.col("v"), "s")
    blocked = scan.prefix_sum(df, ["g"], "pos", F.col("v"), "s", block=7, force=True)
    assert sorted(plain.select("g", "pos", "s").collect()) == sorted(blocked.select("g", "pos", "s").collect())
    for forward in (True, False):
        a = scan.carry(df, ["g"], "pos", {"m": F.col("mark")}, forward).select("g", "pos", "m")
        b = scan.carry(df, ["g"], "pos", {"m": F.col("mark")}, forward, block=7, force=True).select("g", "pos", "m")
        assert sorted(a.collect(), key=str) == sorted(b.collect(), key=str)
    a = scan.with_next(df, ["g"], "pos", {"nv": "v"}).select("g", "pos", "nv")
    b = scan.with_next(df, ["g"], "pos", {"nv": "v"}, block=7, force=True).select("g", "pos", "nv")
    assert sorted(a.collect()) == sorted(b.collect())
    a = scan.global_rank(df.where("g = 0"), [F.col("v")], "pos").select("pos", "rank")
    b = scan.global_rank(df.where("g = 0"), [F.col("v")], "pos", span=8, force=True).select("pos", "rank")
    assert sorted(a.collect()) == sorted(b.collect())


def test_salted_join_keeps_every_pair(spark):
    rng = np.random.default_rng(23)
    pts = [(i, 5.0, 5.0) if i % 3 == 0 else (i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (300, 2)))]
    boxes = [(i, float(x), float(y), float(x + 9), float(y + 9)) for i, (x, y) in enumerate(rng.uniform(0, 95, (60, 2)))]
    left = spark.createDataFrame(pts, "pid long, x double, y double")
    right = spark.createDataFrame(boxes, "bid long, x0 double, y0 double, x1 double, y1 double")
    want = sorted((p, b) for p, x, y in pts for b, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    for levels in ((1,), (1, 4)):
        for force in (False, True):
            got = bucket_join(left, right, point(F.col("x"), F.col("y")), ("x0", "y0", "x1", "y1"), 4, levels=levels, hot_rows=10, force_salt=force)
            assert sorted((r.pid, r.bid) for r in got.select("pid", "bid").collect()) == want


def test_street_side_and_push(spark):
    b = spark.createDataFrame([(1, 10, 10, 8, 6), (2, 200, 200, 5, 5)], "fid long, x0 long, y0 long, w long, h long")
    road = spark.createDataFrame([(x, 5) for x in range(0, 40)], "tx long, ty long")
    assert {r.fid: (r.side, r.tiles) for r in footprints.street_side(b, road).collect()} == {1: ("N", 5), 2: (None, None)}
    pts = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 30.0), (3, 5.0, 0.0)], "pid long, x double, y double")
    segs = spark.createDataFrame([(7, 0.0, 0.0, 20.0, 0.0, 3.0)], "sid long, ax double, ay double, bx double, by double, half double")
    got = {r.pid: (r.x, round(r.y, 3)) for r in joins.push_off_road(pts, segs, 2.0, 3.0).collect()}
    assert got == {1: (5.0, 5.5), 2: (5.0, 30.0)}


def test_raster_matches_centres(spark):
    ring = [(1.2, 1.1), (9.7, 2.4), (7.3, 8.8), (4.1, 4.4), (1.9, 9.3)]
    edges = [(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])]
    runs = tiles.rasterize_polygon(spark.createDataFrame(edges, "k long, ax double, ay double, bx double, by double"), "k")
    got = {(r.tx, r.ty) for r in tiles.runs_to_tiles(runs, ["k"]).collect()}

    def inside(px, py):
        n = 0
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            n += (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax
        return n % 2 == 1

    assert got == {(x, y) for x in range(12) for y in range(12) if inside(x + 0.5, y + 0.5)}


def test_straighten_keeps_shared_vertices_and_squares_streets(spark):
    a = math.radians(3)
    rows = [(0, w, k + 1, w * 100 + k, 50 + 20 * k * math.cos(a), 30.0 * w + 20 * k * math.sin(a)) for w in range(3) for k in range(6)]
    out = {r.vkey: (r.nx, r.ny) for r in network.straighten_network(spark.createDataFrame(rows, "piece long, way_id long, pos long, vkey long, x double, y double")).collect()}
    for w in range(3):
        assert len({out[w * 100 + k][1] for k in range(6)}) == 1


def test_region_cover_descends(spark):
    rows = [("all", None, 0.0, 0.0, 10.0, 10.0), ("a", "all", 0.0, 0.0, 10.0, 5.0), ("b", "all", 0.0, 5.0, 10.0, 10.0), ("a1", "a", 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "id string, parent string, s double, w double, n double, e double").withColumn("ring", F.lit(None).cast("array<struct<x:double,y:double>>"))
    assert ids(network.region_cover(df, (1.0, 1.0, 4.0, 4.0))) == ["a1"]
    assert ids(network.region_cover(df, (1.0, 3.0, 4.0, 7.0))) == ["a", "b"]


def test_wide_seeds_meet_beyond_the_default_reach(spark):
    rows = [(1, 0.0, 0.0, 20.0, 3), (2, 30.0, 0.0, 20.0, 3), (3, 100.0, 0.0, 3.0, 3)]
    got = dict(network.junction_clusters(spark.createDataFrame(rows, "vkey long, x double, y double, width double, links long")).collect())
    assert got == {1: 1, 2: 1, 3: 3}


def test_a_way_that_returns_to_its_piece_has_no_segment_across_the_gap(spark):
    rows = [(0, 1, 1, 1, 20.0, 20.0), (0, 1, 2, 2, 20.0, 0.0), (0, 1, 7, 3, 30.0, 100.0), (0, 1, 8, 4, 30.0, 120.0)]
    out = {r.vkey: (r.nx, r.ny) for r in network.straighten_network(spark.createDataFrame(rows, "piece long, way_id long, pos long, vkey long, x double, y double")).collect()}
    assert out == {1: (20, 20), 2: (20, 0), 3: (30, 100), 4: (30, 120)}


def test_ramp_follows_more_than_eight_ways(spark):
    ground = spark.createDataFrame([(i, i, i + 1, 0.0, math.pi, 2.0) for i in range(12)], "gid long, a_key long, b_key long, a_heading double, b_heading double, length double")
    runs = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 0)], "run long, x double, y double, heading double, end_key long")
    assert [tuple(r) for r in network.ramp_extension(runs, ground, need=20.0).collect()] == [(7, 20.0, 10, True)]


def test_grid_path_steps_along_corners(spark):
    from mapweft.functions import shapes

    rng = np.random.default_rng(3)
    lines = [[(float(x), float(y)) for x, y in rng.uniform(-9, 9, (n, 2))] for n in (1, 2, 3, 5, 8)] + [[(0.0, 0.0), (2.0, 2.0)], [(1.5, 1.0), (1.5, 1.0)], []]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in ln]) for i, ln in enumerate(lines)], "i int, pts array<struct<x:double,y:double>>")
    got = {r.i: r.p and [(p.x, p.y) for p in r.p] for r in df.select("i", shapes.grid_path(F.col("pts")).alias("p")).collect()}
    assert got.pop(7) is None
    assert got[5] == [(0, 0), (1, 0), (1, 1), (2, 1), (2, 2)] and got[6] == [(2, 1)]
    for i, path in got.items():
        ends = [tuple(math.floor(v + 0.5) for v in p) for p in lines[i]]
        assert (path[0], path[-1]) == (ends[0], ends[-1])
        assert len(path) == 1 + sum(abs(b[0] - a[0]) + abs(b[1] - a[1]) for a, b in zip(ends, ends[1:]))
        assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))
        fine = {tuple(math.floor(a[k] + (b[k] - a[k]) * t / 4000 + 0.5) for k in (0, 1)) for a, b in zip(lines[i], lines[i][1:]) for t in range(4001)}
        assert fine <= set(path) | {path[0]}


def test_clusters_of_one_component_over_many_blocks(spark):
    """A street of seeds in rank order and a dense town, both longer than a block, as the sequential walk has them."""
    rng = np.random.default_rng(29)
    rows = [(i, 10.0 * i, 0.0, 6.0, 3) for i in range(24)]
    rows += [(1000 + i, float(x), float(y), float(rng.choice([3.5, 6.0, 12.0])), 3) for i, (x, y) in enumerate(rng.integers(300, 380, (30, 2)))]
    df = spark.createDataFrame(rows, "vkey long, x double, y double, width double, links long")
    want = clusters_by_hand(rows)
    assert dict(network.junction_clusters(df, side=100.0).collect()) == want
    assert dict(network.junction_clusters(df).collect()) == want


def test_dead_ends_do_not_name_a_cluster(spark):
    rows = [(1, 0.0, 0.0, 6.0, 1), (2, 4.0, 0.0, 6.0, 3), (3, 8.0, 0.0, 6.0, 4)]
    got = dict(network.junction_clusters(spark.createDataFrame(rows, "vkey long, x double, y double, width double, links long")).collect())
    assert got == {1: 1, 2: 2, 3: 2}


def test_junction_seeds_have_three_links_or_a_turning_node(spark):
    from mapweft.operators import roads
    from mapweft.plans import q_network
    from mapweft.plans.q_joins import lattice_segments
    from mapweft.plans.views import view

    sf = "/root/testdata/sf0.001"
    links = {r.vkey: r.links for r in roads.vertex_degree(lattice_segments(spark, sf)).collect()}
    turns = {r.near_key for r in view(spark, sf, "v_control").where("on_vertex AND highway = 'mini_roundabout'").collect()}
    got = {r.vkey for r in q_network.junction_seeds(spark, sf).collect()}
    assert got == {k for k, n in links.items() if n >= 3 or k in turns}
    assert min(links[k] for k in got) < 6


def test_a_long_chain_of_ranks_is_settled(spark):
    pts = [(i, i, 5.0 * i, 0.0) for i in range(1100)]
    df = spark.createDataFrame(pts, "id long, rank long, x double, y double")
    assert ids(greedy.spaced_points(df, 7.0)) == list(range(0, 1100, 2))
    assert greedy.spaced_points(df.limit(0), 7.0).count() == 0


def test_a_long_row_of_falling_sizes_is_thinned(spark):
    rows = [(i, 6.0 * i, 0.0, 900 - i, 20, "shed") for i in range(700)]
    kept, want = [], {}
    for i, x, _y, area, long_side, _kind in rows:
        w = math.sqrt(area)
        if any(x - a < V.THIN_GAP * (w + ow) / 2 for a, ow in kept[-20:]):
            want[i] = False
            continue
        factor = 1.0 if area >= V.HOUSE_TILES else min(1.9, math.sqrt(V.HOUSE_TILES / area), max(1.0, 60 / long_side))
        for a, ow in kept:
            gap = x - a - ow / 2
            factor = 1.0 if gap <= 0 else min(factor, 2 * gap / max(1.0, w))
        kept.append((x, w * max(1.0, factor)))
        want[i] = True
    df = spark.createDataFrame(rows, "id long, x double, y double, area long, long_side long, kind string")
    assert {r.id: r.kept for r in network.thin_and_grow(df).collect()} == want


def test_blocks_lie_between_all_streets(spark):
    from mapweft.plans import q_tiles
    from mapweft.plans.views import view

    sf = "/root/testdata/sf0.001"
    blocks, runs = q_tiles.street_blocks(spark, sf)
    open_tiles = {(x, r.ty) for r in runs.collect() for x in range(r.x0, r.x1)}
    streets = {(r.tx, r.ty) for r in view(spark, sf, "v_vertex").selectExpr("x div 8 AS tx", "y div 8 AS ty").distinct().collect()}
    assert streets and not streets & open_tiles
    assert all(r.dense == (r.area > 50 and r.built / r.area >= V.DENSE) for r in blocks.collect())


def test_cell_point_budget_keeps_cells_within_the_reference_budget(spark):
    from mapweft.plans import q_network
    from mapweft.plans.views import view

    sf = "/root/testdata/sf0.01"
    b = view(spark, sf, "v_building").selectExpr("fid", "x0 div 300 AS cx", "y0 div 300 AS cy", "8 + fid % 20 AS n0")
    want = {r.fid: r.n0 for r in b.join(b.groupBy("cx", "cy").agg(F.sum("n0").alias("s")).where("s <= 15000"), ["cx", "cy"]).collect()}
    got = {r.key: r.n for r in q_network.cell_point_budget(spark, sf).collect()}
    assert want and all(got.get(k) == n for k, n in want.items())
