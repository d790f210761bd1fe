"""Road networks: degrees, junctions, distances along roads, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.tags import case
from ..functions.text import lookup
from ..session import store, tasks_for
from . import scan
from .bucket import bucket_join, point


def c(name: str) -> Column:
    return F.col(name)


def road_graph(vertices: DataFrame) -> DataFrame:
    """Edges (way_id, pos, akey, bkey, len) between consecutive vertices."""
    joined = scan.with_next(vertices, ["way_id"], "pos", {"bkey": "vkey", "bx": "x", "by": "y"})
    dx, dy = c("bx") - c("x"), c("by") - c("y")
    return joined.select("way_id", "pos", c("vkey").alias("akey"), "bkey", F.sqrt((dx * dx + dy * dy).cast("double")).alias("len"),
                         c("x").alias("ax"), c("y").alias("ay"), "bx", "by", "category")


def links(segs: DataFrame) -> DataFrame:
    """Distinct (vertex, road, neighbour) links, both ways; segments of a road that lie together stay so."""
    ways = F.array(*[F.struct(c(a).alias("vkey"), c(b).alias("other")) for a, b in (("akey", "bkey"), ("bkey", "akey"))])
    return segs.select("way_id", F.explode(ways).alias("e")).select("e.vkey", "way_id", "e.other").where("vkey <> other").distinct()


def vertex_degree(segs: DataFrame) -> DataFrame:
    """(vkey, links, seed, cut): a seed has three links; a cut is not the middle of one road."""
    per_road = links(segs).groupBy("vkey", "way_id").agg(F.count("*").alias("n")).select("vkey", "n").repartition(tasks_for(segs), "vkey")
    out = per_road.groupBy("vkey").agg(F.sum("n").alias("links"), F.count("*").alias("roads"))
    return out.select("vkey", "links", (c("links") >= 3).alias("seed"), (~((c("links") == 2) & (c("roads") == 1))).alias("cut"))


def vertex_use_count(vertices: DataFrame) -> DataFrame:
    """Ends count twice, inner vertices once; two uses make a network node."""
    ends = vertices.groupBy("way_id").agg(F.max("pos").alias("_n"))
    weight = F.when((c("pos") == 1) | (c("pos") == c("_n")), F.lit(2)).otherwise(F.lit(1))
    out = vertices.join(ends, "way_id").groupBy("vkey").agg(F.sum(weight).alias("uses"))
    return out.select("vkey", "uses", (c("uses") >= 2).alias("node"))


def dominant_angle(segs: DataFrame) -> DataFrame:
    """Length-weighted mean street direction with a 90-degree period, and its strength."""
    dx, dy = (c("bx") - c("ax")).cast("double"), (c("ay") - c("by")).cast("double")
    s = segs.select(F.sqrt(dx * dx + dy * dy).alias("len"), (4 * F.atan2(dy, dx)).alias("a")).where("len >= 1")
    sums = s.agg(F.sum(c("len") * F.sin("a")).alias("sn"), F.sum(c("len") * F.cos("a")).alias("cs"), F.sum("len").alias("total"))
    zero = F.lit(0.0)
    return sums.select(F.coalesce(F.degrees(F.atan2("sn", "cs") / 4), zero).alias("angle"),
                       F.coalesce(F.sqrt(c("sn") * c("sn") + c("cs") * c("cs")) / c("total"), zero).alias("strength"))


def cumulative_distance(vertices: DataFrame) -> DataFrame:
    """Vertices with the distance from the start of their road."""
    dx, dy = c("_nx") - c("x"), c("_ny") - c("y")
    ahead = scan.carry(vertices, ["way_id"], "pos", {"_nx": c("x"), "_ny": c("y")}, forward=False)
    out = ahead.withColumn("_len", F.coalesce(F.sqrt((dx * dx + dy * dy).cast("double")), F.lit(0.0)))
    return scan.prefix_sum(out, ["way_id"], "pos", c("_len"), "dist", inclusive=False).drop("_nx", "_ny", "_len") \
        .withColumn("dist", c("dist").cast("double"))


def next_prev_cut(vertices: DataFrame, cuts: DataFrame) -> DataFrame:
    """Vertices with the nearest cut vertex strictly before and after them on their road."""
    tasks = tasks_for(vertices)
    marked = vertices.repartition(tasks, "vkey").join(cuts.select("vkey").withColumn("_cut", F.lit(True)), "vkey", "left").repartition(tasks, "way_id")
    at = F.when(c("_cut"), F.struct(c("vkey").alias("k"), c("pos").alias("p")))
    out = scan.carry(marked, ["way_id"], "pos", {"_before": at}, forward=True)
    out = scan.carry(out, ["way_id"], "pos", {"_after": at}, forward=False)
    return out.withColumn("before", c("_before.k")).withColumn("after", c("_after.k")).drop("_cut", "_before", "_after")


def road_table(vertices: DataFrame) -> DataFrame:
    """Vertices with `dist` along their road and `links`: other vertices that the road links them to, once per road and vertex.

    All of it comes from one pass along the roads, so what is stored of it serves every later step.
    """
    v = scan.carry(cumulative_distance(vertices), ["way_id"], "pos", {"_a": c("vkey")}, forward=True)
    v = scan.carry(v, ["way_id"], "pos", {"_b": c("vkey")}, forward=False)
    here = W.partitionBy("way_id", "vkey")
    near = F.flatten(F.collect_list(F.filter(F.array("_a", "_b"), lambda k: k != c("vkey"))).over(here))
    n = F.size(F.array_distinct(near))
    return v.withColumn("links", F.when((F.row_number().over(here.orderBy("pos")) == 1) & (n > 0), n)).drop("_a", "_b")


def places(roads: DataFrame) -> DataFrame:
    """(vkey, x, y, width, links, cut) of every vertex of a `road_table`, by one shuffle: degrees as `vertex_degree` has them."""
    width = lookup(c("category"), V.ROAD_WIDTH_M)
    rows = roads.select("vkey", "x", "y", width.alias("width"), "links").repartition(tasks_for(roads), "vkey")
    out = rows.groupBy("vkey").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("width").alias("width"), F.sum("links").alias("links"), F.count("links").alias("_r"))
    return out.select("vkey", "x", "y", "width", "links", (~((c("links") == 2) & (c("_r") == 1))).alias("cut"))


def roads_through(roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """All vertices of the roads that pass a vertex of the nodes."""
    ways = roads.select("way_id", "vkey").join(nodes.select("vkey").distinct(), "vkey", "left_semi").select("way_id").distinct()
    return roads.join(ways, "way_id", "left_semi")


def junction_walk(vertices: DataFrame, members: DataFrame) -> DataFrame:
    """Vertices with the nearest junction vertex strictly before and after them on their road, and how far it is.

    Both directions are carried in one pass each. Adds prev and next: struct(k, d).
    """
    here = F.when(c("_own"), F.struct(c("vkey").alias("k"), c("dist").alias("d")))
    m = (vertices if "dist" in vertices.columns else cumulative_distance(vertices)).withColumn("dist", F.round("dist", 9)).join(members.select("vkey", F.lit(True).alias("_own")), "vkey", "left")
    m = scan.carry(m, ["way_id"], "pos", {"prev": here}, forward=True)
    return scan.carry(m, ["way_id"], "pos", {"next": here}, forward=False).drop("_own")


def control_to_junction(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """As-of join along roads: each control's nearest junction in the direction it faces, within a limit.

    `nodes` has node_id, vkey, highway and facing (forward, backward, both); a crossing
    reaches 15 m, the others 30 m. Of equal distances the earlier road wins, then the way ahead.
    """
    limit = F.when(c("highway") == "crossing", F.lit(V.CROSSING_NEAR_M)).otherwise(F.lit(V.APPROACH_M))
    # A control stands at the first place where its road passes its vertex.
    first = walk.join(nodes.select("vkey").distinct(), "vkey", "left_semi").groupBy("way_id", "vkey").agg(F.min(F.struct("pos", "dist", "prev", "next")).alias("w"))
    m = nodes.join(first, "vkey").select("node_id", "way_id", "highway", "facing", "w.dist", "w.prev", "w.next")
    # Rounded to a micron, so that equal distances tie whatever they were added up from.
    ahead, behind = F.round(c("next.d") - c("dist"), 6), F.round(c("dist") - c("prev.d"), 6)
    ok_a = c("facing").isin("forward", "both") & (ahead <= limit)
    ok_b = c("facing").isin("backward", "both") & (behind <= limit)
    pick = F.least(F.when(ok_a, F.struct(ahead.alias("metres"), c("way_id"), F.lit(0).alias("o"), c("next.k").alias("junction"), F.lit(1).alias("step"))),
                   F.when(ok_b, F.struct(behind.alias("metres"), c("way_id"), F.lit(1).alias("o"), c("prev.k").alias("junction"), F.lit(-1).alias("step"))))
    best = m.withColumn("_p", pick).where("_p IS NOT NULL").groupBy("node_id").agg(F.min("_p").alias("b"))
    return best.select("node_id", "b.way_id", "b.junction", "b.step", "b.metres")


def crossing_between(vertices: DataFrame, cuts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mid-block crossings as a fraction of the way between the cuts around them, on the first road through them.

    `nodes` has node_id and vkey.
    """
    here = F.when(c("_cut"), F.struct(c("vkey").alias("k"), c("dist").alias("d")))
    m = cumulative_distance(vertices).join(cuts.select("vkey", F.lit(True).alias("_cut")), "vkey", "left")
    m = scan.carry(m, ["way_id"], "pos", {"_prev": here}, forward=True)
    m = scan.carry(m, ["way_id"], "pos", {"_next": here}, forward=False)
    first = nodes.join(m, "vkey").groupBy("node_id").agg(F.min(F.struct("way_id", "pos", "dist", "_prev", "_next")).alias("w")).select("node_id", "w.*")
    m = first.where("_prev IS NOT NULL AND _next IS NOT NULL").where("_prev.k <> _next.k")
    span = c("_next.d") - c("_prev.d")
    frac = F.when(span > 0, (c("dist") - c("_prev.d")) / span).otherwise(F.lit(0.0))
    return m.select("node_id", "way_id", c("_prev.k").alias("before"), c("_next.k").alias("after"), frac.alias("fraction"))


def placed_controls(nodes: DataFrame, members: DataFrame, walk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Where control nodes act: (members with lone signals, at a junction, on an arm, between junctions).

    `nodes` has node_id, vkey, highway, facing, stop_all, walk (signals that serve a
    crossing) and style. A node on a junction acts there; another acts on the arm of the
    nearest junction that it faces. A signal with neither makes its vertex a junction of
    its own, unless it serves a crossing: that lies between junctions, as do crossings.
    """
    own = nodes.join(members, "vkey")
    rest = store(nodes.join(members.select("vkey"), "vkey", "left_anti"))
    reach = store(control_to_junction(walk, rest))
    arm = rest.join(reach.drop("metres"), "node_id").join(members.withColumnRenamed("vkey", "junction"), "junction")
    left = rest.join(reach.select("node_id"), "node_id", "left_anti")
    alone = (c("highway") == "traffic_signals") & ~c("walk")
    lone = left.where(alone).select("vkey", c("vkey").alias("cluster")).distinct()
    between = left.where((c("highway") == "crossing") | ((c("highway") == "traffic_signals") & c("walk")))
    return members.unionByName(lone), own.unionByName(left.where(alone).withColumn("cluster", c("vkey"))), arm, between


def junction_kind(arms: DataFrame, flags: DataFrame) -> DataFrame:
    """(cluster, kind) by precedence over its arms; unnamed clusters are dropped.

    `arms` has cluster, way_id, category, roundabout, control; `flags` has
    cluster, mini, turning, all_way.
    """
    a = arms.groupBy("cluster").agg(
        F.count("*").alias("n"), F.bool_or("roundabout").alias("ring"), F.bool_or(c("control") == "signal").alias("sig"),
        F.bool_or(c("control") == "stop").alias("stop"), F.bool_or(c("control") == "give_way").alias("give"),
        F.countDistinct(F.when(c("category") != "road_service", c("way_id"))).alias("through"))
    f = F.lit(False)
    m = a.join(flags, "cluster", "full").select("cluster", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("through", F.lit(0)).alias("through"),
                                                *[F.coalesce(k, f).alias(k) for k in ("ring", "sig", "stop", "give", "mini", "turning", "all_way")])
    kind = case(((c("n") <= 1) & c("turning"), "turning_circle"), (c("ring"), "roundabout"), (c("mini"), "mini_roundabout"), (c("sig"), "signals"),
                (c("all_way"), "all_way_stop"), (c("stop"), "stop"), (c("give"), "give_way"),
                ((c("n") >= 3) & (c("through") <= 1), "service"), (c("n") < 3, None), default="uncontrolled")
    return m.select("cluster", kind.alias("kind")).where("kind IS NOT NULL")


def junction_centre(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def junction_arms(vertices: DataFrame, members: DataFrame, cuts: DataFrame) -> DataFrame:
    """One arm per (road, vertex, next cut) that leaves a cluster; `inbound` if traffic may come in along it.

    `vertices` has way_id, pos, vkey, category and oneway: 1 along the road only, -1
    against it, 0 both.
    """
    # Both ends of an arm learn their clusters in one join, before cuts are carried along the roads.
    known = cuts.select("vkey", F.lit(True).alias("_cut")).join(members.select("vkey", "cluster"), "vkey", "full")
    tasks = tasks_for(vertices)
    marked = vertices.select("way_id", "pos", "vkey", "category", "oneway").repartition(tasks, "vkey").join(known, "vkey").repartition(tasks, "way_id")  # other places are neither seen nor see
    at = F.when(c("_cut"), F.struct(c("vkey").alias("far"), c("cluster").alias("_far")))
    walk = scan.carry(scan.carry(marked, ["way_id"], "pos", {"_before": at}, forward=True), ["way_id"], "pos", {"_after": at}, forward=False)
    sides = F.explode(F.array(F.struct(c("_after").alias("at"), F.lit(1).alias("step")), F.struct(c("_before").alias("at"), F.lit(-1).alias("step"))))
    out = walk.where("cluster IS NOT NULL").select("cluster", "way_id", "vkey", "category", "oneway", sides.alias("s")) \
        .select("cluster", "way_id", "vkey", "category", "oneway", "s.at.*", "s.step").where("far IS NOT NULL AND (_far IS NULL OR _far <> cluster)")
    arms = out.groupBy("cluster", "way_id", "vkey", "far").agg(F.max("step").alias("step"), F.min("category").alias("category"), F.min("oneway").alias("oneway"))
    return arms.withColumn("inbound", (c("oneway") == 0) | (c("oneway") == -c("step"))).drop("oneway")


def junction_controls(arms: DataFrame, at_node: DataFrame, on_arm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arms with control and crosswalk, cluster flags): signal over stop over give-way, for inbound arms.

    A signal on the junction itself holds for every inbound arm; a stop or give-way only
    for the lesser roads, or for all if they are of one class. A stop that says all, or one
    on a junction of one class, makes it an all-way stop. `at_node` has cluster, highway,
    stop_all, walk, style; `on_arm` also way_id, junction and step, the direction of
    travel towards it. Flags: mini, turning, all_way, crosswalk_all.
    """
    rank = F.coalesce(lookup(c("category"), V.ROAD_RANK), F.lit(0))
    a = arms.withColumn("_rank", rank)
    top = a.groupBy("cluster").agg(F.max("_rank").alias("_top"), F.min("_rank").alias("_low"), F.countDistinct("category").alias("_classes"))
    f = F.lit(False)
    sig, stop, give, cross = [c("highway") == k for k in ("traffic_signals", "stop", "give_way", "crossing")]
    here = at_node.groupBy("cluster").agg(
        F.bool_or(sig).alias("_sig"), F.bool_or(stop).alias("_stop"), F.bool_or(give).alias("_give"), F.bool_or(stop & c("stop_all")).alias("_all"),
        F.bool_or(c("highway") == "mini_roundabout").alias("mini"), F.bool_or(c("highway").isin("turning_circle", "turning_loop")).alias("turning"),
        F.bool_or((sig & c("walk")) | (cross & (c("style") != "unmarked"))).alias("_zebra"), F.bool_or(cross & (c("style") == "unmarked")).alias("_bare"))
    there = on_arm.groupBy("cluster").agg(F.bool_or(stop & c("stop_all")).alias("_all2"), F.bool_or(sig & c("walk")).alias("_zebra2"))
    signs = on_arm.groupBy("cluster", "way_id", c("junction").alias("vkey"), (-c("step")).alias("step")).agg(
        F.max(F.when(sig, 3).when(stop, 2).when(give, 1).otherwise(0)).alias("_own"), F.bool_or(cross & (c("style") == "unmarked")).alias("_x0"),
        F.bool_or((cross & (c("style") == "signals")) | (sig & c("walk"))).alias("_x1"), F.max(F.when(cross, c("style"))).alias("_x2"))
    known = top.join(here, "cluster", "full").join(there, "cluster", "full")
    flags = [F.coalesce(k, f).alias(k) for k in ("_sig", "_stop", "_give", "_all", "mini", "turning", "_zebra", "_bare", "_all2", "_zebra2")]
    known = known.select("cluster", "_top", "_low", F.coalesce("_classes", F.lit(0)).alias("_classes"), *flags)
    equal = F.coalesce((c("_top") > 0) & (c("_top") == c("_low")), f)
    known = known.withColumn("all_way", c("_all") | c("_all2") | (c("_stop") & ((c("_classes") <= 1) | equal))).withColumn("_equal", equal)
    joined = a.join(known, "cluster").join(signs, ["cluster", "way_id", "vkey", "step"], "left")
    lesser = c("_rank") < c("_top")
    best = F.greatest(F.when(c("_sig"), 3).otherwise(0), F.when(c("all_way") | (c("_stop") & lesser), 2).otherwise(0),
                      F.when(c("_give") & (lesser | c("_equal")), 1).otherwise(0), F.coalesce("_own", F.lit(0)))
    names = {v: k for k, v in V.CONTROL_RANK.items()}
    walk = F.when(c("_x0"), F.lit("unmarked")).when(c("_x1"), F.lit("signals")).when(c("_x2").isNotNull(), c("_x2")).when(c("_bare"), F.lit("unmarked"))
    ruled = joined.select("cluster", "way_id", "vkey", "far", "step", "category", "inbound",
                          lookup(F.when(c("inbound"), best).otherwise(0), names).alias("control"), walk.alias("crosswalk"))
    return ruled, known.select("cluster", "mini", "turning", "all_way", (c("_zebra") | c("_zebra2")).alias("crosswalk_all"))


def dismissed(centres: DataFrame, arms: DataFrame, lifted: DataFrame, decks: DataFrame) -> DataFrame:
    """Clusters (cluster, x, y) that stay: no arm runs on a lifted way, and the centre is on no deck (x0, y0, w, h)."""
    under = arms.join(lifted.select("way_id"), "way_id", "left_semi").select("cluster").distinct()
    boxes = decks.select(c("x0").alias("bx0"), c("y0").alias("by0"), (c("x0") + c("w")).alias("bx1"), (c("y0") + c("h")).alias("by1"))
    left = centres.join(under, "cluster", "left_anti")
    return bucket_join(left, boxes, point(c("x"), c("y")), ("bx0", "by0", "bx1", "by1"), 64, how="left_anti")


def junction_box(arms: DataFrame, gap: float = 3.0, park: float = 9.0) -> DataFrame:
    """Box over arm mouths with sidewalks, and the box nobody parks in.

    `arms` has cluster, cx, cy, and the unit direction ox, oy with half_w and sidewalk in tiles.
    """
    mouth = c("half_w") + c("sidewalk") + gap
    tipx, tipy = c("cx") + c("ox") * mouth, c("cy") + c("oy") * mouth
    side = c("half_w") + c("sidewalk")
    xs = [tipx - c("oy") * side, tipx + c("oy") * side]
    ys = [tipy + c("ox") * side, tipy - c("ox") * side]
    return arms.groupBy("cluster").agg(
        F.min(F.floor(F.least(*xs))).alias("x0"), F.min(F.floor(F.least(*ys))).alias("y0"),
        F.max(F.ceil(F.greatest(*xs))).alias("x1"), F.max(F.ceil(F.greatest(*ys))).alias("y1")) \
        .select("cluster", "x0", "y0", "x1", "y1", (c("x0") - park).alias("px0"), (c("y0") - park).alias("py0"), (c("x1") + park).alias("px1"), (c("y1") + park).alias("py1"))


def bridge_profile(runs: DataFrame, steps: int = V.RAMP_STEPS) -> DataFrame:
    """Height at `s` along a run: its level over the zone and a storey lost per ramp length; null if too short."""
    reach = c("level") * steps
    away = F.greatest(c("zone0") - c("s"), F.lit(0.0), c("s") - c("zone1"))
    fits = (c("zone0") >= reach) & (c("length") - c("zone1") >= reach)
    height = F.greatest(F.lit(0.0), F.least(c("level").cast("double"), c("level") - away / steps))
    return runs.withColumn("height", F.when(fits, height))
