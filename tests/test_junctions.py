"""The junction chain on a small network: arms, controls by travel direction, lone signals, crossings, bridges."""

import pytest
from pyspark.sql import functions as F

from mapweft.operators import roads as R

# A main road 10-14 along x, a one-way side street 20-12-21 across it, a long road 14-30-31-32.
WAYS = {1: ("road_major", 0, [(10, 0, 0), (11, 10, 0), (12, 20, 0), (13, 30, 0), (14, 40, 0)]),
        2: ("road_minor", 1, [(20, 20, -10), (12, 20, 0), (21, 20, 10)]),
        3: ("road_major", 0, [(14, 40, 0), (30, 140, 0), (31, 240, 0), (32, 340, 0)])}


@pytest.fixture(scope="module")
def net(spark):
    rows = [(w, pos, key, x, y, cat, one) for w, (cat, one, pts) in WAYS.items() for pos, (key, x, y) in enumerate(pts, 1)]
    v = spark.createDataFrame(rows, "way_id long, pos long, vkey long, x long, y long, category string, oneway int")
    segs = R.road_graph(v)
    deg = R.vertex_degree(segs)
    members = deg.where("seed").select("vkey", F.col("vkey").alias("cluster"))
    return v, deg.where("cut"), members


def nodes(spark, *rows):
    full = [(n, vkey, highway, facing, more.get("all", False), more.get("walk", False), more.get("style", "marked")) for n, vkey, highway, facing, more in rows]
    return spark.createDataFrame(full, "node_id long, vkey long, highway string, facing string, stop_all boolean, walk boolean, style string")


def ruled(spark, net, *rows):
    v, cuts, members = net
    every, at, arm, between = R.placed_controls(nodes(spark, *rows), members, R.junction_walk(v, members))
    arms, flags = R.junction_controls(R.junction_arms(v, every, cuts), at, arm)
    return ({(r.cluster, r.way_id, r.far): (r.inbound, r.control, r.crosswalk) for r in arms.collect()}, {r.cluster: r for r in flags.collect()},
            sorted(r.node_id for r in between.collect()), every)


def test_arms_and_their_direction(spark, net):
    arms, _, _, every = ruled(spark, net)
    assert arms == {(12, 1, 10): (True, "none", None), (12, 1, 14): (True, "none", None), (12, 2, 20): (True, "none", None), (12, 2, 21): (False, "none", None)}
    assert [tuple(r) for r in every.collect()] == [(12, 12)]


def test_a_stop_before_a_junction_holds_for_its_arm(spark, net):
    arms, flags, between, _ = ruled(spark, net, (1, 11, "stop", "forward", {}), (2, 13, "give_way", "both", {}), (3, 13, "crossing", "backward", {"style": "unmarked"}))
    assert arms[12, 1, 10] == (True, "stop", None) and arms[12, 1, 14] == (True, "give_way", "unmarked") and arms[12, 2, 20][1] == "none"
    assert not flags[12].all_way and not between


def test_a_sign_on_the_junction_holds_for_lesser_roads(spark, net):
    arms, _, _, _ = ruled(spark, net, (1, 12, "give_way", "both", {}))
    assert arms[12, 2, 20][1] == "give_way" and arms[12, 2, 21][1] == arms[12, 1, 10][1] == "none"
    arms, flags, _, _ = ruled(spark, net, (1, 12, "stop", "both", {"all": True}), (2, 12, "crossing", "both", {"style": "unmarked"}))
    assert {a[1] for a in arms.values() if a[0]} == {"stop"} and flags[12].all_way and not flags[12].crosswalk_all
    assert {a[2] for a in arms.values()} == {"unmarked"}
    arms, flags, _, _ = ruled(spark, net, (1, 12, "traffic_signals", "both", {"walk": True}), (2, 12, "stop", "both", {}))
    assert {a[1] for a in arms.values() if a[0]} == {"signal"} and flags[12].crosswalk_all and arms[12, 2, 21][1] == "none"


def test_nodes_far_from_junctions(spark, net):
    arms, _, between, every = ruled(spark, net, (1, 30, "traffic_signals", "both", {}), (2, 31, "crossing", "both", {}), (3, 31, "traffic_signals", "both", {"walk": True}),
                                    (4, 11, "crossing", "backward", {}), (5, 31, "stop", "both", {}))
    assert arms[30, 3, 14] == (True, "signal", None) and arms[30, 3, 32] == (True, "signal", None)
    assert between == [2, 3, 4] and {tuple(r) for r in every.collect()} == {(12, 12), (30, 30)}
    v, cuts, _ = net
    got = {r.node_id: (r.way_id, r.before, r.after, r.fraction) for r in R.crossing_between(v, cuts, nodes(spark, (2, 31, "crossing", "both", {}), (4, 11, "crossing", "both", {}))).collect()}
    assert got == {2: (3, 14, 32, pytest.approx(2 / 3)), 4: (1, 10, 14, 0.25)} or got[4] == (1, 10, 12, 0.5)


def test_kinds_and_bridges(spark, net):
    v, cuts, members = net
    every, at, arm, _ = R.placed_controls(nodes(spark, (1, 30, "traffic_signals", "both", {})), members, R.junction_walk(v, members))
    arms, flags = R.junction_controls(R.junction_arms(v, every, cuts), at, arm)
    kinds = {r.cluster: r.kind for r in R.junction_kind(arms.withColumn("roundabout", F.lit(False)), flags).collect()}
    assert kinds == {12: "uncontrolled", 30: "signals"}
    centres = spark.createDataFrame([(12, 20.0, 0.0), (30, 140.0, 0.0)], "cluster long, x double, y double")
    deck = spark.createDataFrame([(120, -5, 20, 5)], "x0 long, y0 long, w long, h long")
    none = deck.limit(0)
    stay = lambda lifted, decks: {r.cluster for r in R.dismissed(centres, arms, v.where(lifted), decks).collect()}
    assert stay("false", none) == {12, 30} and stay("false", deck) == {12} and stay("way_id = 2", none) == {30} and stay("way_id = 3", deck) == {12}
