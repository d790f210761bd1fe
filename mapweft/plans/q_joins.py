"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.text import lookup
from ..operators import joins as J
from ..operators import painter as PT
from ..operators import rings as R
from ..operators.bucket import bucket_join, point
from . import sqltext as S
from .registry import query
from .views import outlines, table, view

VB, VP, VA, VO, VG = "v_building", "v_point", "v_area", "v_outline", "v_ground"


def c(name):
    return F.col(name)


def centres(spark, d):
    return view(spark, d, VB).select("*", (c("x0") + c("w") / 2.0).alias("px"), (c("y0") + c("h") / 2.0).alias("py"))


# ------------------------------------------------------------------- identity joins
@query("way_node_locations", """, bad AS (SELECT DISTINCT way_id FROM v_vertex WHERE vkey % 97 = 0)
SELECT way_id, pos, x, y FROM v_vertex WHERE way_id NOT IN (SELECT way_id FROM bad)""".replace(", bad", "WITH bad", 1), ["v_vertex"])
def way_node_locations(spark, d):
    v = view(spark, d, "v_vertex")
    nodes = v.where("vkey % 97 <> 0").groupBy(c("vkey").alias("id")).agg(F.min("x").alias("x"), F.min("y").alias("y"))
    return J.way_node_locations(v.select("way_id", "pos", c("vkey").alias("node")), nodes).select("way_id", "pos", "x", "y")


@query("relation_members", """SELECT o_custkey AS rel_id, o_orderkey AS way_id, n AS n_members
FROM orders JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING bool_and(o_totalprice > 20000)) q ON k = o_custkey""")
def relation_members(spark, d):
    o = table(spark, d, "orders")
    members = o.select(c("o_custkey").alias("rel_id"), c("o_orderkey").alias("way_id"))
    return J.relation_members(members, o.where("o_totalprice > 20000").select(c("o_orderkey").alias("way_id"))).select("rel_id", "way_id", "n_members")


# ------------------------------------------------------------------- containment
_CLAIMS = f"""(SELECT pid, arg_min(fid, (-area, fid)) AS fid FROM {S.ring_hits("(SELECT min(pid) AS pid, x, y FROM v_point GROUP BY x, y)", "v_outline", "pid", "fid", reach=1)} h
 JOIN {S.ring_area("v_outline", "fid")} a USING (fid) WHERE inside OR distance < 1 GROUP BY pid)"""


@query("points_in_footprint", f"SELECT pid, fid FROM {_CLAIMS} q", [VP, VO])
def points_in_footprint(spark, d):
    """Uses mapped inside a building, or at its door, go to the largest such building; each place once."""
    return R.claimed_points(view(spark, d, VP), outlines(spark, d, VO))


_CENTRE = "(SELECT *, x0 + w / 2.0 AS px, y0 + h / 2.0 AS py FROM v_building)"


def around(edges: str = "v_ground") -> str:
    """(fid, aid, area) of the areas strictly around the centres of buildings."""
    hits = S.ring_hits(_CENTRE, edges, "fid", "aid", "px", "py")
    return f"(SELECT fid, aid, area, category FROM {hits} h JOIN {S.ring_area(edges, 'aid')} a USING (aid) JOIN v_area USING (aid) WHERE inside)"


@query("area_of_point", f"""SELECT fid, arg_min(category, (area, aid)) AS category FROM v_building LEFT JOIN {around()} q USING (fid) GROUP BY fid""", [VB, VA, VG])
def area_of_point(spark, d):
    return R.smallest_around(centres(spark, d), outlines(spark, d, VG), view(spark, d, VA), ["category"], "fid").select("fid", "category")


_KIND = "CASE WHEN {c} = 'schoolyard' AND w * h < 120 THEN 'civic' ELSE " + S.case_of("{c}", V.KIND_FOR_AREA) + " END"


@query("zone_override", f"""WITH hit AS (SELECT * FROM {around()} q),
 land AS (SELECT fid, arg_min(category, (area, aid)) AS land FROM hit WHERE aid % 3 <> 0 GROUP BY fid),
 zone AS (SELECT fid, arg_min(category, (area, aid)) AS zone FROM hit WHERE aid % 3 = 0 GROUP BY fid)
SELECT fid, CASE WHEN zone IS NOT NULL THEN {_KIND.replace('{c}', 'zone')} ELSE {_KIND.replace('{c}', 'land')} END AS kind
FROM v_building LEFT JOIN land USING (fid) LEFT JOIN zone USING (fid)""", [VB, VA, VG])
def zone_override(spark, d):
    from ..functions.tags import kind_for_area

    areas, edges = view(spark, d, VA), outlines(spark, d, VG)
    land = R.smallest_around(centres(spark, d), edges.where("aid % 3 <> 0"), areas.withColumnRenamed("category", "land"), ["land"], "fid").drop("covered")
    both = R.smallest_around(land, edges.where("aid % 3 = 0"), areas.withColumnRenamed("category", "zone"), ["zone"], "fid")
    tiles = c("w") * c("h")
    return both.select("fid", F.when(c("covered"), kind_for_area(c("zone"), tiles)).otherwise(kind_for_area(c("land"), tiles)).alias("kind"))


@query("seed_nudge", f"""SELECT fid, CAST(coalesce(sum(CASE WHEN aid IS NULL THEN 0 WHEN aid % 2 = 0 THEN aid % 10 ELSE 1 END), 0) AS BIGINT) AS nudge
FROM v_building LEFT JOIN {around()} q USING (fid) GROUP BY fid""", [VB, VA, VG])
def seed_nudge(spark, d):
    regions = view(spark, d, VA).withColumn("seed", F.when(c("aid") % 2 == 0, c("aid") % 10))
    return R.seeds_around(centres(spark, d), outlines(spark, d, VG), regions, "fid")


# ------------------------------------------------------------------- semi and anti joins
# Every ring of a mapped building is an outline of its own here, so a courtyard is built on too.
_RINGS = "(SELECT fid * 2 + ring AS rid, ax, ay, ex, ey FROM v_outline)"
MISSING = f"(SELECT pid FROM v_point WHERE pid NOT IN (SELECT pid FROM {S.ring_hits('v_point', _RINGS, 'pid', 'rid')} h WHERE inside))"


def not_built_on(spark, d):
    rings = outlines(spark, d, VO).withColumn("rid", c("fid") * 2 + c("ring"))
    return R.outside_all(view(spark, d, VP), rings, key="rid")


@query("only_missing", f"SELECT pid FROM {MISSING} q", [VP, VO])
def only_missing(spark, d):
    return not_built_on(spark, d).select("pid")


@query("gap_semi", """SELECT fid FROM v_building b WHERE EXISTS (SELECT 1 FROM v_area a WHERE b.x0 <= a.x0 + side AND b.x0 + w >= a.x0 AND b.y0 <= a.y0 + side AND b.y0 + h >= a.y0)""", [VB, VA])
def gap_semi(spark, d):
    return J.touching_any(view(spark, d, VB), view(spark, d, VA), "fid").select("fid")


@query("within_distance_anti", f"""SELECT pid FROM v_point WHERE pid NOT IN (SELECT pid FROM {S.ring_hits("v_point", "v_outline", "pid", "fid", reach=4)} h
 WHERE inside OR distance <= 4)""", [VP, VO])
def within_distance_anti(spark, d):
    return R.outside_all(view(spark, d, VP), outlines(spark, d, VO), distance=4.0).select("pid")


@query("stall_building_anti", """SELECT pid FROM (SELECT pid, x AS sx, y AS sy FROM v_point) p
 WHERE NOT EXISTS (SELECT 1 FROM v_building WHERE sx < x0 + w AND x0 < sx + 3 AND sy < y0 + h AND y0 < sy + 5)""", [VP, VB])
def stall_building_anti(spark, d):
    stalls = view(spark, d, VP).select("pid", c("x").alias("x0"), c("y").alias("y0"), F.lit(3).alias("w"), F.lit(5).alias("h"))
    return J.without_overlap(stalls, view(spark, d, VB), "pid").select("pid")


@query("keep_clear_anti", """SELECT pid FROM (SELECT pid, x AS sx, y AS sy FROM v_point) p
 WHERE NOT EXISTS (SELECT 1 FROM v_area WHERE category = 'commercial' AND sx < x0 + 40 AND x0 < sx + 3 AND sy < y0 + 20 AND y0 < sy + 5)""", [VP, VA])
def keep_clear_anti(spark, d):
    stalls = view(spark, d, VP).select("pid", c("x").alias("x0"), c("y").alias("y0"), F.lit(3).alias("w"), F.lit(5).alias("h"))
    forecourts = view(spark, d, VA).where("category = 'commercial'").select("x0", "y0", F.lit(40).alias("w"), F.lit(20).alias("h"))
    return J.without_overlap(stalls, forecourts, "pid").select("pid")


@query("near_canopy_anti", """SELECT pid FROM v_point p WHERE use_value = 'automobile' AND NOT EXISTS (SELECT 1 FROM v_area
 WHERE category = 'industrial' AND abs(p.x - x0) < 40 AND abs(p.y - y0) < 40)""", [VP, VA])
def near_canopy_anti(spark, d):
    stations = view(spark, d, VP).where("use_value = 'automobile'")
    served = view(spark, d, VA).where("category = 'industrial'").select(c("x0").alias("x"), c("y0").alias("y"))
    return J.not_near(stations, served, 40).select("pid")


@query("station_points_unclaimed", f"""SELECT pid FROM v_point WHERE use_value = 'automobile' AND pid NOT IN (SELECT pid FROM {_CLAIMS} q)""", [VP, VO])
def station_points_unclaimed(spark, d):
    points = view(spark, d, VP)
    return J.unclaimed(points.where("use_value = 'automobile'"), R.claimed_points(points, outlines(spark, d, VO))).select("pid")


# ------------------------------------------------------------------- neighbours
@query("neighbour_levels", """SELECT a.fid, CASE WHEN count(b.fid) >= 4 THEN CAST(median(b.levels) AS DOUBLE) END AS median
FROM (SELECT fid, x0 + w / 2.0 AS cx, y0 + h / 2.0 AS cy FROM v_building) a LEFT JOIN (SELECT fid, x0 + w / 2.0 AS tx, y0 + h / 2.0 AS ty, levels FROM v_building WHERE levels IS NOT NULL) b
 ON power(cx - tx, 2) + power(cy - ty, 2) <= 14400 GROUP BY a.fid""", [VB])
def neighbour_levels(spark, d):
    return J.neighbour_levels(view(spark, d, VB))


@query("lot_overlaps", """SELECT a.fid, b.fid AS other FROM v_building a JOIN v_building b ON a.fid < b.fid
 AND a.x0 < b.x0 + b.w AND b.x0 < a.x0 + a.w AND a.y0 < b.y0 + b.h AND b.y0 < a.y0 + a.h""", [VB])
def lot_overlaps(spark, d):
    return J.lot_overlaps(view(spark, d, VB))


@query("feature_cells", """SELECT fid, cx, cy FROM (SELECT fid, y0, h, unnest(range(x0 // 300, (x0 + w) // 300 + 1)) AS cx FROM v_building) q,
 LATERAL (SELECT unnest(range(y0 // 300, (y0 + h) // 300 + 1)) AS cy) r""", [VB])
def feature_cells(spark, d):
    return J.feature_cells(view(spark, d, VB), "fid")


# ------------------------------------------------------------------- tiles
def road_tiles(spark, d):
    """Eight paved tiles east of every road vertex."""
    v = view(spark, d, "v_vertex").select("x", "y").distinct()
    return v.select((F.explode(F.sequence(c("x"), c("x") + 7))).alias("tx"), c("y").alias("ty")).distinct()


def road_runs(spark, d):
    """The same tiles as runs, which may overlap."""
    return view(spark, d, "v_vertex").select(c("y").alias("ty"), c("x").alias("x0"), (c("x") + 8).alias("x1"))


ROAD_TILES = "road_tile AS (SELECT DISTINCT x + k AS tx, y AS ty FROM (SELECT DISTINCT x, y FROM v_vertex) v, (SELECT unnest(range(8)) AS k) r)"
TILES = "tile AS (SELECT b.*, tx, ty FROM v_building b, LATERAL (SELECT unnest(range(x0, x0 + w)) AS tx) a, LATERAL (SELECT unnest(range(y0, y0 + h)) AS ty) c)"


@query("footprints_on_ground", f"""WITH {ROAD_TILES}, {TILES}
SELECT fid, CAST(coalesce(n, 0) * 2 AS BIGINT) AS weight FROM v_building LEFT JOIN (SELECT fid, count(*) AS n FROM tile JOIN road_tile USING (tx, ty) GROUP BY fid) q USING (fid)""", [VB, "v_vertex"])
def footprints_on_ground(spark, d):
    return J.weight_under(view(spark, d, VB), road_runs(spark, d).withColumn("weight", F.lit(2))).select("fid", c("weight").cast("bigint").alias("weight"))


_OWNED = "owned AS (SELECT tx, ty, min(fid) AS fid, CAST(arg_min(coalesce(levels, 1), fid) AS BIGINT) AS levels FROM tile GROUP BY tx, ty)"


def owned_runs(spark, d, keep=()):
    """Stretches of rows with the first building that claims them."""
    first = view(spark, d, VB).withColumn("levels", F.coalesce("levels", F.lit(1)))
    return PT.claimed(PT.box_runs(first, ["fid", *keep]), "fid", list(keep))


@query("party_walls", f"""WITH {TILES}, {_OWNED}
SELECT fid, x, y, side, max(storeys) AS storeys FROM (
 SELECT a.fid, a.tx AS x, a.ty AS y, 'N' AS side, b.levels AS storeys FROM owned a JOIN owned b ON b.tx = a.tx AND b.ty = a.ty - 1 AND a.fid <> b.fid
 UNION ALL SELECT a.fid, a.tx, a.ty + 1, 'N', b.levels FROM owned a JOIN owned b ON b.tx = a.tx AND b.ty = a.ty + 1 AND a.fid <> b.fid
 UNION ALL SELECT a.fid, a.tx, a.ty, 'W', b.levels FROM owned a JOIN owned b ON b.tx = a.tx - 1 AND b.ty = a.ty AND a.fid <> b.fid
 UNION ALL SELECT a.fid, a.tx + 1, a.ty, 'W', b.levels FROM owned a JOIN owned b ON b.tx = a.tx + 1 AND b.ty = a.ty AND a.fid <> b.fid) q GROUP BY 1, 2, 3, 4""", [VB])
def party_walls(spark, d):
    return J.party_walls(owned_runs(spark, d, ["levels"]))


@query("edge_crossing_anti", f"""WITH {ROAD_TILES}, {TILES}, built AS (SELECT DISTINCT tx, ty FROM tile),
 e AS (SELECT pid AS eid, x AS ax, y AS ay, x - 1 AS bx, y AS bv FROM v_point)
SELECT eid FROM e WHERE NOT (EXISTS (SELECT 1 FROM road_tile WHERE tx = ax AND ty = ay) AND EXISTS (SELECT 1 FROM road_tile WHERE tx = bx AND ty = bv))
 AND NOT (EXISTS (SELECT 1 FROM built WHERE tx = ax AND ty = ay) AND EXISTS (SELECT 1 FROM built WHERE tx = bx AND ty = bv))""", [VB, "v_vertex", VP])
def edge_crossing_anti(spark, d):
    edges = view(spark, d, VP).select(c("pid").alias("eid"), c("x").alias("ax"), c("y").alias("ay"), (c("x") - 1).alias("bx"), c("y").alias("by"))
    built = J.explode_tiles(view(spark, d, VB), []).distinct()
    return J.edge_crossing_anti(edges, road_tiles(spark, d), built).select("eid")


# ------------------------------------------------------------------- overlays
_EDITS = "(SELECT p_partkey AS fid, p_partkey % 11 = 0 AS deleted, CASE WHEN p_partkey % 4 = 0 THEN 'Renamed ' || p_brand END AS new_name, CASE WHEN p_partkey % 6 = 0 THEN 'civic' END AS new_kind FROM part WHERE p_size > 25)"


@query("overlay_join", f"""SELECT b.fid, coalesce(new_name, name) AS name, coalesce(new_kind, kind) AS kind FROM v_building b LEFT JOIN {_EDITS} e ON e.fid = b.fid WHERE NOT coalesce(deleted, FALSE)""", [VB])
def overlay_join(spark, d):
    p, k = table(spark, d, "part").where("p_size > 25"), c("p_partkey")
    edits = p.select(k.alias("fid"), (k % 11 == 0).alias("deleted"), F.when(k % 4 == 0, F.concat(F.lit("Renamed "), c("p_brand"))).alias("name"),
                     F.when(k % 6 == 0, F.lit("civic")).alias("kind"))
    return J.overlay_join(view(spark, d, VB), edits, "fid", ["name", "kind"]).select("fid", "name", "kind")


@query("area_overrides_paint", """WITH base AS (SELECT aid, CASE WHEN aid % 5 = 1 THEN 'park' ELSE category END AS category FROM v_area WHERE aid % 7 <> 0),
 added AS (SELECT 1000000000 + aid AS aid, 'orchard' AS category FROM v_area WHERE aid % 9 = 0), a AS (SELECT * FROM base UNION ALL SELECT * FROM added)
SELECT aid, category, 'ground' AS layer FROM a WHERE category NOT IN ('forest', 'scrub', 'tree_single', 'hedge')
UNION ALL SELECT aid, category, 'vegetation' FROM a WHERE category IN ('forest', 'scrub', 'tree_single', 'hedge', 'orchard', 'cemetery', 'wetland')""", [VA])
def area_overrides_paint(spark, d):
    from ..operators import layers

    areas = view(spark, d, VA).select("aid", "category")
    edits = areas.select("aid", (c("aid") % 7 == 0).alias("deleted"), F.when(c("aid") % 5 == 1, F.lit("park")).alias("category"))
    added = view(spark, d, VA).where("aid % 9 = 0").select((c("aid") + 1000000000).alias("aid"), F.lit("orchard").alias("category"))
    return layers.area_overrides_paint(areas, edits, added)


# ------------------------------------------------------------------- lines
def lattice_segments(spark, d):
    """Road segments between consecutive vertices, as boxes (sid, ax, ay, bx, by)."""
    from ..operators import scan

    v = scan.with_next(view(spark, d, "v_vertex"), ["way_id"], "pos", {"bx": "x", "by": "y", "bkey": "vkey"})
    return v.select("way_id", "pos", (c("way_id") * 100 + c("pos")).alias("sid"), c("x").alias("ax"), c("y").alias("ay"), "bx", "by", c("vkey").alias("akey"), "bkey", "category")


SEGMENTS = """seg AS (SELECT a.way_id, a.pos, a.way_id * 100 + a.pos AS sid, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS bv, a.vkey AS akey, b.vkey AS bkey, a.category
 FROM v_vertex a JOIN v_vertex b ON a.way_id = b.way_id AND b.pos = a.pos + 1)"""


@query("push_off_road")
def push_off_road(spark, d):
    half = lookup(c("category"), {k: v / 2 for k, v in V.ROAD_WIDTH_M.items()})
    segs = lattice_segments(spark, d).select(*[c(n).cast("double").alias(n) for n in ("ax", "ay", "bx", "by")], "sid", half.alias("half"))
    pts = view(spark, d, VP).select("pid", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    out = J.push_off_road(pts, segs, need=2.0)
    return out.select("pid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@query("control_on_vertex", """SELECT DISTINCT node_id, near_key AS vkey, highway FROM v_control WHERE on_vertex AND EXISTS (SELECT 1 FROM v_vertex WHERE vkey = near_key)""", ["v_control", "v_vertex"])
def control_on_vertex(spark, d):
    ctl = view(spark, d, "v_control").where("on_vertex").select("node_id", c("near_key").alias("vkey"), "highway")
    return ctl.join(view(spark, d, "v_vertex").select("vkey"), "vkey", "left_semi")


_SEGD = "sqrt(power(x - (ax + t * (bx - ax)), 2) + power(y - (ay + t * (bv - ay)), 2))"


@query("control_near_segment", f"""WITH {SEGMENTS}, cand AS (SELECT node_id, x, y, ax, ay, bx, bv, sid,
   greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (bv - ay)) / CAST((bx - ax) * (bx - ax) + (bv - ay) * (bv - ay) AS DOUBLE))) AS t
  FROM (SELECT * FROM v_control WHERE NOT on_vertex) c JOIN seg ON x BETWEEN least(ax, bx) - 5 AND greatest(ax, bx) + 5 AND y BETWEEN least(ay, bv) - 5 AND greatest(ay, bv) + 5),
 near AS (SELECT *, {_SEGD} AS dist, row_number() OVER (PARTITION BY node_id ORDER BY round({_SEGD}, 9), sid) AS n FROM cand WHERE {_SEGD} <= 5)
SELECT node_id, sid, round(dist, 6) AS dist, round(t, 6) AS t FROM near WHERE n = 1""", ["v_control", "v_vertex"])
def control_near_segment(spark, d):
    ctl = view(spark, d, "v_control").where("NOT on_vertex").select("node_id", c("x").cast("double").alias("x"), c("y").cast("double").alias("y"))
    segs = lattice_segments(spark, d).select("sid", *[c(n).cast("double").alias(n) for n in ("ax", "ay", "bx", "by")])
    out = J.nearest_segment(ctl, segs, "node_id", 5.0, ["sid"], cell=20)
    return out.select("node_id", "sid", F.round("dist", 6).alias("dist"), F.round("t", 6).alias("t"))


@query("cells_inside_shape", """WITH c AS (SELECT DISTINCT CAST(x0 // 300 AS BIGINT) AS cx, CAST(y0 // 300 AS BIGINT) AS cy FROM v_building)
SELECT cx, cy FROM c WHERE cx >= 1 AND cx <= 3 AND cy >= 1 AND cy <= 4 AND NOT (cx >= 3 AND cy <= 1)""", [VB])
def cells_inside_shape(spark, d):
    # An L-shaped selection around whole cells, slightly outside their edges.
    pts = [(250, 250), (900, 250), (900, 600), (1250, 600), (1250, 1550), (250, 1550)]
    ring = [(float(a[0]), float(a[1]), float(b[0]), float(b[1])) for a, b in zip(pts, pts[1:] + pts[:1])]
    edges = spark.createDataFrame(ring, "ax double, ay double, bx double, by double")
    cells = view(spark, d, VB).select(F.floor(c("x0") / 300).alias("cx"), F.floor(c("y0") / 300).alias("cy")).distinct()
    return J.cells_inside(edges, cells)


@query("bbox_filter", """SELECT fid, x0 <= 900 AND x0 + w >= 300 AND y0 <= 800 AND y0 + h >= 200 AS meets, x0 >= 300 AND x0 + w <= 900 AND y0 >= 200 AND y0 + h <= 800 AS within_box,
 x0 BETWEEN 300 AND 900 AND y0 BETWEEN 200 AND 800 AS corner FROM v_building""", [VB])
def bbox_filter(spark, d):
    from ..functions import geo as P

    q = [F.lit(v) for v in (200, 300, 800, 900)]
    b = (c("y0"), c("x0"), c("y0") + c("h"), c("x0") + c("w"))
    return view(spark, d, VB).select("fid", P.boxes_meet(*b, *q).alias("meets"), P.box_contains(*q, *b).alias("within_box"),
                                     P.box_has_point(*q, c("y0"), c("x0")).alias("corner"))


def near_pairs(df, reach):
    """Pairs of rows nearer than `reach`, for reuse."""
    other = df.select(c("id").alias("oid"), c("x").alias("ox"), c("y").alias("oy"))
    near = (c("id") < c("oid")) & ((c("x") - c("ox")) ** 2 + (c("y") - c("oy")) ** 2 <= reach * reach)
    return bucket_join(df, other, point(c("x"), c("y")), ("ox", "oy", "ox", "oy"), reach, near, reach=reach)
