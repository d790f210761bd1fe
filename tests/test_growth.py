"""Steps whose memory or shuffled bytes once grew faster than the input: plans, and small cases beside a plain form."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from mapweft.operators import network as N
from mapweft.operators import roads as R
from mapweft.plans.views import view

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_roads_are_dealt_out_by_their_size(spark, monkeypatch):
    from mapweft import session

    for share in (1 << 16, 1 << 13):
        monkeypatch.setattr(session, "TASK_BYTES", share)
        tasks = session.tasks_for(view(spark, SF, "v_vertex"))
        plan = plan_of(entry.queries()["next_prev_cut"](spark, SF))
        dealt = {tuple(m) for m in re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)}
        assert {("vkey", str(tasks)), ("way_id", str(tasks)), ("l_orderkey", str(tasks))} <= dealt
    assert tasks > 10


def test_links_are_counted_where_the_roads_lie(spark):
    v = view(spark, SF, "v_vertex")
    plan = plan_of(R.vertex_degree(R.road_graph(v)))
    # Two tables by their key, and what a road links by vertex.
    assert len(re.findall(r" Exchange ", plan)) == 3


def test_a_road_table_has_the_degrees_of_its_places(spark):
    rows = [(1, i, k, k, 0, "road_minor") for i, k in enumerate((10, 11, 12, 10, 11, 13), 1)] + [(2, 1, 11, 11, 0, "road_major"), (2, 2, 14, 14, 0, "road_major"), (3, 1, 15, 15, 0, "road_major")]
    v = spark.createDataFrame(rows, "way_id long, pos long, vkey long, x long, y long, category string")
    got = {r.vkey: (r.links, r.cut) for r in R.places(R.road_table(v)).collect()}
    want = {r.vkey: (r.links, r.cut) for r in R.vertex_degree(R.road_graph(v)).collect()}
    assert {k: n for k, n in got.items() if n[0] is not None} == want
    assert got[15][0] is None and want[11] == (4, True) and want[10] == (2, False)


@pytest.mark.parametrize("near", [3.0, 12.0])
def test_pairs_of_a_block_are_all_found(near):
    rng = np.random.default_rng(5)
    xy, w, keys = rng.integers(-30, 60, (300, 2)).astype(float), rng.choice([1.0, 3.5, 8.0], 300), rng.permutation(300)
    inner = xy[:, 0] < 20
    got = {(r.a, r.b): (r.d, r.lim) for r in N._close_pairs(xy, w, keys, inner, near).itertuples()}
    want = {}
    for i, j in itertools.combinations(range(300), 2):
        d, lim = round(math.hypot(*(xy[i] - xy[j])), 6), max(near, w[i] + w[j])
        if d <= lim and (inner[i] or inner[j]):
            want[min(keys[i], keys[j]), max(keys[i], keys[j])] = (d, lim)
    assert got == want


def test_strokes_of_all_slopes_have_the_tiles_within_their_reach(spark):
    from mapweft.operators import painter as P

    rng = np.random.default_rng(9)
    ends = [tuple(map(float, e)) for e in rng.integers(-70, 80, (30, 4))] + [(3.0, 5.0, 3.0, 5.0), (60.0, -4.0, 70.0, -4.0), (70.0, 9.0, 60.0, 9.0), (5.0, 20.0, 5.0, 2.0)]
    rows = [(i % 3, *e, (0.5, 1.0, 2.5)[i % 3]) for i, e in enumerate(ends)]
    df = spark.createDataFrame(rows, "kind int, ax double, ay double, bx double, by double, half double").withColumns({k: F.floor(F.col(f"a{k[-1]}") / 64) for k in ("_cx", "_cy")})
    got = {(r.kind, x, r.ty) for r in P.united(P.stroke_masks(df, F.col("half"), ["kind"]), ["kind"]).collect() for x in range(r.x0, r.x1)}
    want = set()
    for kind, ax, ay, bx, by, half in rows:
        for x, y in itertools.product(range(int(min(ax, bx)) - 4, int(max(ax, bx)) + 5), range(int(min(ay, by)) - 4, int(max(ay, by)) + 5)):
            n = (bx - ax) ** 2 + (by - ay) ** 2
            t = max(0.0, min(1.0, ((x + 0.5 - ax) * (bx - ax) + (y + 0.5 - ay) * (by - ay)) / n)) if n else 0.0
            if math.hypot(x + 0.5 - ax - t * (bx - ax), y + 0.5 - ay - t * (by - ay)) <= half + 1e-9:
                want.add((kind, x, y))
    assert got == want


@pytest.mark.parametrize("query", ["rasterize_line", "ground_share_per_chunk"])
def test_painting_unites_before_it_sorts(spark, query):
    """Strokes and runs are united by an aggregate of bits; no sort sees a row of every stroke."""
    plan = plan_of(entry.queries()[query](spark, SF))
    assert "bit_or" in plan and not re.search(r"Sort \[ty#\d+L? ASC NULLS FIRST, _b#", plan)


def test_points_are_pushed_like_a_loop_over_all_roads(spark):
    """Crowded, blocked, far and exactly met points; segments longer than a bucket, and equal ones of other widths."""
    from mapweft.operators import joins as J

    rng = np.random.default_rng(12)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-60, 160, (400, 2)))] + [(900, 10.0, 0.0), (901, 5000.0, 0.0), (902, None, 3.0)]
    segs = [(i, *map(float, rng.integers(-50, 150, 4)), float(rng.choice([1.0, 3.0, 6.0]))) for i in range(25)]
    segs += [(50, 0.0, 0.0, 20.0, 0.0, 3.0), (49, 0.0, 0.0, 20.0, 0.0, 3.0), (51, 0.0, 0.0, 20.0, 0.0, 6.0), (52, 40.0, 9.0, 40.0, 9.0, 4.0)]
    want = {902: (None, 3.0)}
    for pid, x, y in pts[:-1]:
        left, clear = 18.0, False
        for _ in range(6):
            worst = None
            for sid, ax, ay, bx, by, half in segs:
                n = (bx - ax) ** 2 + (by - ay) ** 2
                t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0.0
                dx, dy = x - (ax + t * (bx - ax)), y - (ay + t * (by - ay))
                gap = 2.0 + half - math.sqrt(dx * dx + dy * dy)
                if gap > 0 and (worst is None or (gap, -sid) > worst[:2]):
                    worst = (gap, -sid, dx, dy)
            if worst is None:
                clear = True
                break
            gap, _, dx, dy = worst
            step, length = gap + 0.5, math.sqrt(dx * dx + dy * dy)
            if length < 1e-6 or step > left or left - step <= 0:
                break
            x, y, left = x + dx / length * step, y + dy / length * step, left - step
        if clear:
            want[pid] = (round(x, 6), round(y, 6))
    p = spark.createDataFrame(pts, "pid long, x double, y double")
    s = spark.createDataFrame(segs, "sid long, ax double, ay double, bx double, by double, half double")
    for cell in (3.0, 500.0):
        got = {r.pid: (r.x if r.x is None else round(r.x, 6), round(r.y, 6)) for r in J.push_off_road(p, s, 2.0, cell).collect()}
        assert got == want
    assert 900 not in want and 0 < len(want) < len(pts) and any(pid < 900 and want[pid] != (round(x, 6), round(y, 6)) for pid, x, y in pts[:-1] if pid in want)


def test_roads_are_read_once_to_push_points(spark):
    """One plan whose moves are an array's; no round joins the roads again, and none is broadcast."""
    plan = plan_of(entry.queries()["push_off_road"](spark, SF))
    assert plan.count("FileScan parquet") == 4  # roads from two tables, points for their pairs and for themselves
    assert "SortMergeJoin [_cx" in plan


def test_a_whole_rectangle_is_dealt_out_by_its_size(spark, monkeypatch):
    """Rows that are nearly all alike take few bytes; tasks are asked for, and no step of the blur has fewer."""
    from mapweft.operators import tiles as T

    monkeypatch.setattr(T, "DENSE_ROWS", 500)
    cells = spark.createDataFrame([(0, 0, 1.0), (99, 40, 2.0)], "tx long, ty long, v double")
    n = -(-100 * 41 // 500)
    for df in (T.dense(cells, "tx", "ty", {"v": 0.0}), T.blur_box3(cells, "v", 2)):
        dealt = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\), (\w+)", plan_of(df))
        assert dealt and set(dealt) == {(str(n), "REPARTITION_BY_NUM")}
        assert df.count() == 4100 and df.rdd.getNumPartitions() == n


def test_three_blurs_of_an_axis_agree_over_blocks(spark):
    """Negative places, edges that go on, blocks narrower than the field, an empty field."""
    from mapweft.operators import tiles as T

    rng = np.random.default_rng(4)
    field = np.where(rng.random((23, 90)) < 0.2, rng.uniform(0, 9, (23, 90)), 0.0)
    field[0, 0], field[-1, -1] = 3.0, 5.0
    cells = [(int(x) - 40, int(y) - 11, float(field[y, x])) for y, x in zip(*np.nonzero(field))]
    want = field
    for axis in (1, 0):
        for _ in range(3):
            pad = np.pad(want, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
            want = sum(np.take(pad, range(k, k + want.shape[axis]), axis) for k in range(9)) / 9
    df = spark.createDataFrame(cells, "tx int, ty long, v double")
    for block in (8, 256):
        got = T.blur_box3(df, "v", 4, block)
        assert [t for _, t in got.dtypes] == ["int", "bigint", "double"]
        rows = {(r.tx, r.ty): r.v for r in got.collect()}
        assert len(rows) == want.size and all(abs(rows[x - 40, y - 11] - want[y, x]) < 1e-9 for y in range(23) for x in range(90))
    assert T.blur_box3(df.where("v < 0"), "v", 4).count() == 0


def test_clip_paints_its_roads_once(spark):
    """One pass over the roads gives the cover and what a clip leaves, and no stroke is a row of its own."""
    plan = plan_of(entry.queries()["clip_cover_to_shape"](spark, SF))
    assert len(re.findall(r"FileScan parquet \[l_orderkey", plan)) == 1
    assert "MapInPandas" in plan and "transform(" not in plan


def test_clip_in_one_sweep_is_the_clip_of_the_cover(spark):
    from mapweft.operators import painter as P

    rng = np.random.default_rng(3)
    kinds = ["residential", "industrial", "pavement", "verge", "road_minor", "water", "unknown"]
    rows = [(int(y), int(x), int(x + w), kinds[k], bool(held)) for y, x, w, k, held in zip(*(rng.integers(a, b, 150) for a, b in ((0, 6), (-90, 150), (1, 40), (0, 7), (0, 2))))]
    df = spark.createDataFrame(rows, "ty long, x0 long, x1 long, paint string, held boolean").repartition(3)

    def tiles(runs):
        return {(x, r.ty): r.value for r in runs.collect() for x in range(r.x0, r.x1)}

    held = df.where("held").select("ty", "x0", "x1")
    want = tiles(P.clip_cover_to_shape(P.ground_cover(df.drop("held")), held, held.limit(0)))
    assert tiles(P.clipped_cover(df)) == want and len(set(want.values())) > 3


def test_stalls_are_not_broadcast(spark):
    """A few car parks in the plan are very many stalls: neither they nor those that overlap go to every task."""
    from mapweft.operators import joins as J

    lots = spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("s_suppkey AS x0", "explode(sequence(1, 9)) AS y0", "3 AS w", "5 AS h").withColumn("sid", F.col("x0") * 10 + F.col("y0"))
    built = view(spark, SF, "v_building")
    out = J.without_overlap(lots, built, "sid")
    assert "Broadcast" not in plan_of(out)
    boxes = [(b.x0, b.y0, b.x0 + b.w, b.y0 + b.h) for b in built.collect()]
    want = {r.sid for r in lots.collect() if not any(a < r.x0 + r.w and r.x0 < c and b < r.y0 + r.h and r.y0 < d for a, b, c, d in boxes)}
    assert {r.sid for r in out.collect()} == want


@pytest.mark.parametrize("cell", [7, 64, 512])
def test_nearest_along_rows_and_columns(spark, cell):
    """Long, repeated and negative runs, tiles that are flagged themselves, and some out of reach of all; no tile is a row."""
    from mapweft.operators import tiles as T

    rng = np.random.default_rng(5)
    runs = [(int(y), int(x), int(x + w)) for y, x, w in zip(rng.integers(-60, 90, 60), rng.integers(-150, 150, 60), rng.choice([1, 8, 8, 90], 60))] + [(0, -900, 900), (0, -900, 900)]
    asks = [(int(x), int(y)) for x, y in rng.integers(-160, 160, (200, 2))] + [(5000, 5000), (3, 0), (3, 0)]
    df = T.directional_nearest(spark.createDataFrame(asks, "tx long, ty long"), spark.createDataFrame(runs, "ty long, x0 long, x1 long"), 40, cell)
    on = {(x, y) for y, a, b in runs for x in range(a, b)}

    def far(x, y, dx, dy):
        return next((k for k in range(41) if (x + k * dx, y + k * dy) in on), None)

    want = {(x, y): tuple(far(x, y, *step) for step in ((-1, 0), (1, 0), (0, -1), (0, 1))) for x, y in asks}
    got = df.collect()
    assert {(r.tx, r.ty): (r.west, r.east, r.north, r.south) for r in got} == want and len(got) == len(want)
    plan = plan_of(entry.queries()["directional_nearest"](spark, SF))
    assert len(re.findall(r"(?<!Running)Window \[", plan)) == 1  # the one that numbers the places of a road


def test_rounds_write_only_seeds_that_move_or_wait(spark, monkeypatch):
    """Seeds far from all others are written by no round."""
    from mapweft.session import store

    wrote = []

    def counted(df):
        out = store(df)
        wrote.append(out.count())
        return out

    monkeypatch.setattr(N, "store", counted)
    rows = [(i, 1000.0 * i, 0.0, 6.0, 3) for i in range(200)] + [(1000, 5.0, 0.0, 6.0, 3), (1001, 7.0, 0.0, 6.0, 2)]
    got = dict(N.junction_clusters(spark.createDataFrame(rows, "vkey long, x double, y double, width double, links long")).collect())
    assert got == {i: i for i in range(200)} | {1000: 0, 1001: 1001} and sum(wrote) == 3
