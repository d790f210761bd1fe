"""Queries of the tile operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as V
from ..operators import ground as GR
from ..operators import joins as J
from ..operators import painter as P
from ..operators import tiles as R
from . import sqltext as S
from .q_census import GROUND, WATER, ground_runs, ground_tiles
from .q_joins import ROAD_TILES, SEGMENTS, TILES, lattice_segments, road_tiles
from .q_order import ON_TILE, on_tiles
from .q_scalar import _PIP, _QUAD, quads
from ..functions.text import lookup
from .registry import query
from .views import outlines, view

VB, VP, VA, VX, VG = "v_building", "v_point", "v_area", "v_vertex", "v_ground"


def c(name):
    return F.col(name)


def area_tiles(spark, d, where="true"):
    a = view(spark, d, VA).where(where).select("aid", "category", "x0", "y0", c("side").alias("w"), c("side").alias("h"))
    return J.explode_tiles(a, ["aid", "category"])


def AREA_TILES(where="TRUE"):
    return f"(SELECT aid, category, tx, ty FROM v_area, LATERAL (SELECT unnest(range(x0, x0 + side)) AS tx) a, LATERAL (SELECT unnest(range(y0, y0 + side)) AS ty) b WHERE {where})"


@query("rasterize_polygon", f"""SELECT fid, tx, ty FROM (SELECT fid, tx, ty, ax, ay, bx, bv, cx, cy, dx, dy, tx + 0.5 AS px, ty + 0.5 AS py FROM {_QUAD} q,
 LATERAL (SELECT unnest(range(CAST(ax AS BIGINT), CAST(bx AS BIGINT) + 1)) AS tx) a, LATERAL (SELECT unnest(range(CAST(ay AS BIGINT), CAST(cy AS BIGINT) + 1)) AS ty) b) t WHERE {_PIP}""", [VB])
def rasterize_polygon(spark, d):
    from ..functions.geo import edges

    e = quads(spark, d).select("fid", F.explode(edges(c("pts"))).alias("e")) \
        .select("fid", c("e.a.x").alias("ax"), c("e.a.y").alias("ay"), c("e.b.x").alias("bx"), c("e.b.y").alias("by"))
    return R.runs_to_tiles(R.rasterize_polygon(e, "fid"), ["fid"]).select("fid", "tx", "ty")


_KEY = "((xor(xor({a} * 73856093, {b} * 19349663), {s}) % 1000003) / 1000003.0)"


def keyed(a, b, salt):
    return _KEY.format(a=a, b=b, s=f"CAST({salt * 83492791} AS BIGINT)")


# ------------------------------------------------------------------- painted ground
def strokes(spark, d):
    """Roads of every class with their pavements and verges."""
    return P.road_strokes(lattice_segments(spark, d).where("bx IS NOT NULL"))


def asphalt(spark, d):
    """Runs of carriageway, as few as there are."""
    return P.united(P.stroke_masks(strokes(spark, d).where("paint LIKE 'road%'"), c("half"), []))


def land(spark, d, where="true"):
    """Runs of the land-use areas by their outlines."""
    areas = view(spark, d, VA).where(where).select("aid", "category")
    return R.rasterize_polygon(outlines(spark, d, VG), "aid").join(areas, "aid").select("aid", "category", "ty", "x0", "x1")


def ponds(spark, d):
    p = view(spark, d, VP).where("use_value = 'machinery'").select(c("x").alias("x0"), c("y").alias("y0"), F.lit(12).alias("w"), F.lit(12).alias("h"))
    return P.box_runs(p, [])


def cover(spark, d):
    painted = [P.stroke_masks(strokes(spark, d), c("half"), ["paint"]), P.masked(land(spark, d).withColumn("paint", c("category")), ["paint"]),
               P.masked(ponds(spark, d).withColumn("paint", F.lit("water")), ["paint"])]
    return P.ground_cover(painted[0].unionByName(painted[1]).unionByName(painted[2]))


# Half widths in tiles of three metres: whole tiles, pavements and verges on both sides.
_D2 = "power(tx + 0.5 - (ax + t * (bx - ax)), 2) + power(ty + 0.5 - (ay + t * (bv - ay)), 2)"
STROKES = f"""stroke AS (SELECT DISTINCT category, paint, tx, ty FROM (SELECT *, greatest(0.0, least(1.0, ((tx + 0.5 - ax) * (bx - ax) + (ty + 0.5 - ay) * (bv - ay)) / CAST((bx - ax) * (bx - ax) + (bv - ay) * (bv - ay) AS DOUBLE))) AS t
  FROM (SELECT DISTINCT ax, ay, bx, bv, category FROM seg) s JOIN (VALUES ('road_major', 'road_major', 2.0), ('road_major', 'pavement', 2.5), ('road_medium', 'road_medium', 1.0), ('road_medium', 'pavement', 2.5),
   ('road_medium', 'verge', 1.5), ('road_minor', 'road_minor', 1.0), ('road_minor', 'pavement', 2.0), ('road_minor', 'verge', 1.5)) AS w(category, paint, half) USING (category),
   LATERAL (SELECT unnest(range(least(ax, bx) - 3, greatest(ax, bx) + 4)) AS tx) a, LATERAL (SELECT unnest(range(least(ay, bv) - 3, greatest(ay, bv) + 4)) AS ty) b) q WHERE sqrt({_D2}) <= half + 1e-9),
 asphalt AS (SELECT DISTINCT tx, ty FROM stroke WHERE paint LIKE 'road%')"""
LAND = """land AS (SELECT aid, category, tx, ty FROM (SELECT aid, tx, ty FROM (SELECT aid, ty, unnest(range(l, r)) AS tx FROM (SELECT aid, l, r, unnest(range(b, u)) AS ty
   FROM (SELECT aid, min(ax) AS l, max(ax) AS r, min(ay) AS b, max(ay) AS u FROM v_ground GROUP BY aid) box) q) t JOIN v_ground USING (aid) GROUP BY aid, tx, ty
   HAVING count(*) FILTER (WHERE (ay > ty + 0.5) <> (ey > ty + 0.5) AND tx + 0.5 < ax + (ty + 0.5 - ay) * (ex - ax) / (ey - ay)::DOUBLE) % 2 = 1) i JOIN v_area USING (aid))"""
_RANK = S.case_of("paint", {n: i for i, n in enumerate(V.PAINT_LAYERS)})
COVER = f"""cover AS (SELECT tx, ty, {S.case_of('paint', V.GROUND_CLASS)} AS value FROM (SELECT tx, ty, arg_max(paint, {_RANK}) AS paint FROM (
 SELECT tx, ty, category AS paint FROM land UNION ALL SELECT tx, ty, paint FROM stroke UNION ALL SELECT tx, ty, 'water' FROM water_tile) p GROUP BY tx, ty) q)"""
_CELLS = "CAST(floor(tx / 50.0) AS BIGINT) AS cx, CAST(floor(ty / 50.0) AS BIGINT) AS cy"


@query("rasterize_line", f"""WITH {SEGMENTS}, {STROKES} SELECT ty, min(tx) AS x0, max(tx) + 1 AS x1 FROM (SELECT tx, ty, tx - row_number() OVER (PARTITION BY ty ORDER BY tx) AS g FROM asphalt) q GROUP BY ty, g""", [VX])
def rasterize_line(spark, d):
    """Carriageways of all classes, each by its width, as runs."""
    return asphalt(spark, d).select("ty", "x0", "x1")


@query("ground_cover", f"WITH {SEGMENTS}, {STROKES}, {LAND}, {WATER}, {COVER} SELECT {_CELLS}, value, count(*) AS n FROM cover GROUP BY 1, 2, 3", [VX, VA, VG, VP])
def ground_cover(spark, d):
    return P.per_cell(cover(spark, d), 50, ["value"])


_BIO = "CASE category WHEN 'industrial' THEN 254 WHEN 'commercial' THEN 230 WHEN 'schoolyard' THEN 115 WHEN 'cemetery' THEN 0 ELSE 192 END"
_LAND_RANK = S.case_of("category", {n: i for i, n in enumerate(V.PAINT_ORDER[:20])})


@query("biome_cover", f"""WITH {LAND}, base AS (SELECT tx, ty, arg_max({_BIO}, {_LAND_RANK}) AS g FROM land WHERE category <> 'commercial' GROUP BY tx, ty), wood AS (SELECT DISTINCT tx, ty, 230 AS w FROM land WHERE category = 'commercial'),
 p AS (SELECT tx, ty, CASE WHEN w IS NOT NULL AND coalesce(g, -1) NOT IN (0, 254, 102) THEN w ELSE coalesce(g, w) END AS biome FROM base FULL JOIN wood USING (tx, ty)),
 shore AS (SELECT DISTINCT tx + i AS tx, ty + j AS ty FROM p, (SELECT unnest([0, 1, -1, 0, 0]) AS i, unnest([0, 0, 0, 1, -1]) AS j) o WHERE biome = 0)
SELECT biome, count(*) AS n, CAST(sum(tx + ty) AS BIGINT) AS mark FROM (SELECT p.tx, p.ty, CASE WHEN s.tx IS NOT NULL AND biome NOT IN (0, 254, 115, 102) THEN 59 ELSE biome END AS biome FROM p LEFT JOIN shore s ON s.tx = p.tx AND s.ty = p.ty) q GROUP BY biome""", [VA, VG])
def biome_cover(spark, d):
    """Biomes of the land in the order of painting; commercial land stands for woods."""
    order = lookup(c("category"), {n: i for i, n in enumerate(V.PAINT_ORDER[:20])})
    t = land(spark, d).select("ty", "x0", "x1", order.alias("ord"), "category", F.expr(_BIO).alias("biome"))
    return P.marks(P.biome_cover(t.where("category <> 'commercial'"), t.where("category = 'commercial'")), ["biome"])


@query("woodland_grade", f"""WITH {WATER}, {LAND}, f AS (SELECT DISTINCT tx, ty FROM land WHERE category = 'residential'), core AS (SELECT tx, ty FROM (SELECT tx, ty, tx + i AS nx, ty + j AS ny FROM f, (SELECT unnest(range(-2, 3)) AS i) i, (SELECT unnest(range(-2, 3)) AS j) j) a
  SEMI JOIN f b ON b.tx = a.nx AND b.ty = a.ny GROUP BY tx, ty HAVING count(*) = 25)
SELECT CAST(CASE WHEN core.tx IS NOT NULL THEN 3 ELSE 2 END AS INT) AS grade, count(*) AS n, CAST(sum(f.tx + f.ty) AS BIGINT) AS mark FROM f LEFT JOIN core ON core.tx = f.tx AND core.ty = f.ty
WHERE NOT EXISTS (SELECT 1 FROM water_tile w WHERE w.tx = f.tx AND w.ty = f.ty) GROUP BY 1""", [VA, VP, VG])
def woodland_grade(spark, d):
    return P.marks(P.woodland_grade(land(spark, d, "category = 'residential'"), ponds(spark, d)), ["grade"])


@query("clip_cover_to_shape", f"""WITH {SEGMENTS}, {STROKES}, {LAND}, {WATER}, {COVER},
 held AS (SELECT tx, ty FROM land WHERE aid % 2 = 0 UNION SELECT tx, ty FROM stroke WHERE paint = 'pavement' AND category IN ('road_major', 'road_medium'))
SELECT CAST(floor(g.tx / 50.0) AS BIGINT) AS cx, CAST(floor(g.ty / 50.0) AS BIGINT) AS cy, CAST(CASE WHEN h.tx IS NOT NULL OR value = 4 THEN value ELSE 5 END AS INT) AS value, count(*) AS n
FROM cover g LEFT JOIN held h ON h.tx = g.tx AND h.ty = g.ty GROUP BY 1, 2, 3""", [VX, VP, VA, VG])
def clip_cover_to_shape(spark, d):
    """Every other area is selected; main roads with their pavements, and water, stay outside too."""
    main = (c("paint") == "pavement") & c("category").isin(V.THROUGH_ROADS)
    roads = P.stroke_masks(strokes(spark, d).withColumn("held", main), c("half"), ["paint", "held"])
    areas = land(spark, d).select("ty", "x0", "x1", c("category").alias("paint"), (c("aid") % 2 == 0).alias("held"))
    lakes = ponds(spark, d).withColumns({"paint": F.lit("water"), "held": F.lit(False)})
    painted = roads.unionByName(P.masked(areas, ["paint", "held"])).unionByName(P.masked(lakes, ["paint", "held"]))
    return P.per_cell(P.clipped_cover(painted), 50, ["value"])


@query("clear_under", f"""WITH {ROAD_TILES}, {TILES} SELECT x AS tx, y AS ty FROM (SELECT DISTINCT x, y FROM v_point) p WHERE NOT EXISTS (SELECT 1 FROM road_tile WHERE tx = x AND ty = y) AND NOT EXISTS (SELECT 1 FROM tile WHERE tx = x AND ty = y)""", [VX, VB, VP])
def clear_under(spark, d):
    plants = view(spark, d, VP).select(c("x").alias("tx"), c("y").alias("ty")).distinct()
    return GR.clear_under(plants, road_tiles(spark, d), J.explode_tiles(view(spark, d, VB), []))


_FOREST = AREA_TILES("category = 'residential'")


@query("scatter_points", f"""WITH free AS (SELECT DISTINCT tx, ty FROM {_FOREST} a), pick AS (SELECT tx // 11 AS px, ty // 11 AS py, arg_min(tx, (u, ty, tx)) AS tx, arg_min(ty, (u, ty, tx)) AS ty FROM (SELECT *, {keyed('tx', 'ty', 1)} AS u FROM free) f GROUP BY 1, 2)
SELECT tx, ty, CASE WHEN {keyed('px', 'py', 4)} < 0.45 THEN 'bush' ELSE 'tree' END AS kind FROM pick WHERE {keyed('px', 'py', 3)} < least(1.0, 0.75 * power({keyed('(px * 11 // 70)', '(py * 11 // 70)', 2)}, 1.6))""", [VA])
def scatter_points(spark, d):
    return GR.scatter_points(area_tiles(spark, d, "category = 'residential'").select("tx", "ty").distinct())


@query("lattice_in_polygon", f"""WITH {TILES} SELECT aid, tx, ty FROM (SELECT aid, unnest(range(x0, x0 + side, 3)) AS tx, y0, side FROM v_area WHERE category = 'cemetery') a, LATERAL (SELECT unnest(range(y0, y0 + side, 2)) AS ty) b
 WHERE NOT EXISTS (SELECT 1 FROM tile t WHERE t.tx = a.tx AND t.ty = b.ty)""", [VA, VB])
def lattice_in_polygon(spark, d):
    graves = view(spark, d, VA).where("category = 'cemetery'").select("aid", "x0", "y0", c("side").alias("w"), c("side").alias("h"))
    return GR.lattice_in_polygon(graves, "aid", 3, 2, P.box_runs(view(spark, d, VB), []))


def _on(dx, dy):
    return f"EXISTS (SELECT 1 FROM asphalt m WHERE m.tx = a.tx + {dx} AND m.ty = a.ty + {dy})"


KERB = f"""kerb AS (SELECT tx, ty, NOT near AS kerbside, far AS car_park, vert AS vertical FROM (SELECT a.tx, a.ty, {' AND '.join(_on(x, y) for x, y in ((4, 0), (-4, 0), (0, 4), (0, -4)))} AS near,
 {' AND '.join(_on(x, y) for x, y in ((8, 0), (-8, 0), (0, 8), (0, -8)))} AS far, {_on(0, 2)} OR {_on(0, -2)} AS vert FROM asphalt a WHERE (a.tx - 4) % 14 = 0 AND (a.ty - 4) % 14 = 0) q WHERE NOT near OR far)"""


@query("kerb_candidates", f"WITH {SEGMENTS}, {STROKES}, {KERB} SELECT tx, ty, car_park, vertical FROM kerb", [VX])
def kerb_candidates(spark, d):
    return P.kerb_candidates(asphalt(spark, d))


@query("parking_zones", f"""WITH {SEGMENTS}, {STROKES}, {KERB}, s AS (SELECT x AS tx, y AS ty, 3 AS w, 5 AS h, 1 AS src FROM v_point WHERE use_value = 'automobile' AND {keyed('x', 'y', 1)} <= 0.6
 UNION ALL SELECT tx, ty, 3, 5, 2 FROM (SELECT unnest(range(x0, x0 + side, 3)) AS tx, y0, side FROM v_area WHERE category = 'commercial') a, LATERAL (SELECT unnest(range(y0, y0 + side, 17)) AS ty) b WHERE {keyed('tx', 'ty', 2)} <= 0.55
  AND NOT EXISTS (SELECT 1 FROM v_building v WHERE tx < v.x0 + v.w AND v.x0 < tx + 3 AND ty < v.y0 + v.h AND v.y0 < ty + 5)
 UNION ALL SELECT tx, ty, w, h, 3 FROM (SELECT *, CASE WHEN vertical THEN 3 ELSE 5 END AS w, CASE WHEN vertical THEN 5 ELSE 3 END AS h FROM kerb) k WHERE {keyed('tx', 'ty', 3)} <= CASE WHEN car_park THEN 0.75 ELSE 0.45 END
  AND NOT EXISTS (SELECT 1 FROM v_area v WHERE category = 'industrial' AND tx < v.x0 + 40 AND v.x0 < tx + k.w AND ty < v.y0 + 20 AND v.y0 < ty + k.h))
SELECT tx, ty, CAST(w AS INT) AS w, CAST(h AS INT) AS h, CAST(src AS INT) AS src FROM (SELECT *, row_number() OVER (PARTITION BY tx // 8, ty // 8 ORDER BY src, ty, tx) AS n FROM s) q WHERE n = 1""", [VX, VP, VA, VB])
def parking_zones(spark, d):
    """Stalls on drives, on car parks away from buildings, and along kerbs away from forecourts."""
    drives = view(spark, d, VP).where("use_value = 'automobile'").select(c("x").alias("tx"), c("y").alias("ty"), F.lit(3).alias("w"), F.lit(5).alias("h"))
    lots = view(spark, d, VA).where("category = 'commercial'").select("aid", "x0", "y0", c("side").alias("w"), c("side").alias("h"))
    none = P.box_runs(drives.select(c("tx").alias("x0"), c("ty").alias("y0"), "w", "h"), []).limit(0)
    stalls = GR.lattice_in_polygon(lots, "aid", 3, 17, none).select("tx", "ty", F.lit(3).alias("w"), F.lit(5).alias("h")).distinct()
    kerbs = P.kerb_candidates(asphalt(spark, d)).withColumns({"w": F.when(c("vertical"), 3).otherwise(5), "h": F.when(c("vertical"), 5).otherwise(3)})
    forecourts = view(spark, d, VA).where("category = 'industrial'").select("x0", "y0", F.lit(40).alias("w"), F.lit(20).alias("h"))

    def off(rects, blockers):
        named = rects.withColumns({"x0": c("tx"), "y0": c("ty"), "sid": F.shiftleft(c("tx"), 32) + c("ty")})
        return J.without_overlap(named, blockers, "sid").drop("x0", "y0", "sid")

    return GR.parking_zones(drives, off(stalls, view(spark, d, VB)), off(kerbs, forecourts))


@query("retile", f"""WITH {ROAD_TILES}, {WATER}, {GROUND}, cell AS (SELECT tx // 256 AS cx, ty // 256 AS cy, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM ground GROUP BY 1, 2),
 grid AS (SELECT cx, unnest(range(b, t + 1)) AS cy FROM (SELECT unnest(range(l, r + 1)) AS cx, b, t FROM (SELECT min(cx) AS l, max(cx) AS r, min(cy) AS b, max(cy) AS t FROM cell) e) q)
SELECT cx, cy, coalesce(n, 0) AS n_set, 65536 - coalesce(n, 0) AS n_default, coalesce(total, 0) AS total FROM grid LEFT JOIN cell USING (cx, cy)""", [VX, VP])
def retile(spark, d):
    return R.retile(ground_runs(spark, d), "value").select("cx", "cy", "n_set", "n_default", "total")


@query("palette_to_class", """SELECT l_orderkey, l_linenumber, CAST(CASE WHEN r = 100 AND g = 100 AND b = 100 THEN 2 WHEN r = 90 AND g = 100 AND b = 35 THEN 3 WHEN r = 0 AND g = 138 AND b = 255 THEN 4 ELSE 0 END AS INT) AS value, count(*) AS n
FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 90 ELSE 0 END AS r, CASE l_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 100 WHEN 2 THEN 138 ELSE 1 END AS g, CASE l_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 35 WHEN 2 THEN 255 ELSE 2 END AS b FROM lineitem) q GROUP BY 1, 2, 3""")
def palette_to_class(spark, d):
    from .views import table

    k = c("l_partkey") % 4
    px = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k == 0, 100).when(k == 1, 90).otherwise(0).alias("r"),
                                            F.when(k <= 1, 100).when(k == 2, 138).otherwise(1).alias("g"), F.when(k == 0, 100).when(k == 1, 35).when(k == 2, 255).otherwise(2).alias("b"))
    palette = spark.createDataFrame([(100, 100, 100, 2), (90, 100, 35, 3), (0, 138, 255, 4)], "r int, g int, b int, value int")
    return GR.palette_to_class(px, palette).groupBy("l_orderkey", "l_linenumber", "value").agg(F.count("*").alias("n"))


@query("spawn_by_ground", f"""WITH {ROAD_TILES}, {WATER}, {GROUND} SELECT tx, ty, CAST(CASE WHEN value <> 4 AND {keyed('tx', 'ty', 5)} <= 0.40 THEN round_even(10 * (0.4 + (1.0 - 0.4) * {keyed('tx', 'ty', 6)}), 0) ELSE 0 END AS INT) AS spawn FROM ground""", [VX, VP])
def spawn_by_ground(spark, d):
    return GR.spawn_by_ground(ground_tiles(spark, d))


# ------------------------------------------------------------------- connected ground
@query("connected_tiles", f"""WITH RECURSIVE {ON_TILE}, run AS (SELECT ty, min(tx) AS x0, max(tx) + 1 AS x1, ty * 4294967296 + min(tx) AS rid FROM (SELECT tx, ty, tx - row_number() OVER (PARTITION BY ty ORDER BY tx) AS g FROM on_tile) q GROUP BY ty, g),
 pair AS (SELECT a.rid AS a, b.rid AS b FROM run a JOIN run b ON b.ty = a.ty + 1 AND a.x0 < b.x1 AND b.x0 < a.x1), near AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
 lab AS (SELECT 0 AS n, rid AS id, rid AS l FROM run UNION ALL
  (WITH cur AS (SELECT id, l FROM lab), nxt AS (SELECT c.id, least(c.l, coalesce(min(d.l), c.l)) AS l FROM cur c LEFT JOIN near ON near.a = c.id LEFT JOIN cur d ON d.id = near.b GROUP BY c.id, c.l)
   SELECT (SELECT max(n) + 1 FROM lab), id, l FROM nxt WHERE EXISTS (SELECT 1 FROM nxt x JOIN cur y USING (id) WHERE x.l < y.l)))
SELECT l AS piece, CAST(sum(x1 - x0) AS BIGINT) AS tiles, min(x0) AS x0, min(ty) AS y0, max(x1) AS x1, max(ty) + 1 AS y1 FROM lab JOIN run ON rid = id WHERE n = (SELECT max(n) FROM lab) GROUP BY l""", [VB])
def connected_tiles(spark, d):
    """4-connected pieces of the built mask."""
    return GR.connected_tiles(on_tiles(spark, d))


def street_blocks(spark, d):
    """Blocks on the street lattice: one cell per lattice node."""
    v = view(spark, d, VX)
    streets = v.select(F.floor(c("x") / 8).alias("tx"), F.floor(c("y") / 8).alias("ty")).distinct()
    built = view(spark, d, VB).select(F.floor(c("x0") / 8).alias("tx"), F.floor(c("y0") / 8).alias("ty")).distinct()
    return GR.block_density(streets, built, least=50 / 64)  # cells of 64 tiles each


@query("block_density")
def block_density(spark, d):
    return street_blocks(spark, d)[0]


@query("pave_dense_blocks")
def pave_dense_blocks(spark, d):
    blocks, runs = street_blocks(spark, d)
    green = view(spark, d, VP).select(F.floor(c("x") / 8).alias("tx"), F.floor(c("y") / 8).alias("ty"))
    return GR.pave_dense_blocks(blocks, runs, green)
