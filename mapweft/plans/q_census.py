"""Queries of the census, the building aggregates and the road aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as V
from ..operators import census as C
from ..operators import joins as J
from ..operators import layers as L
from ..operators import painter as PT
from . import sqltext as S
from .q_joins import ROAD_TILES, SEGMENTS, TILES, lattice_segments, owned_runs, road_tiles
from .registry import query
from .views import table, view

VB, VP, VA, VX = "v_building", "v_point", "v_area", "v_vertex"


def c(name):
    return F.col(name)


def people(spark, d):
    return C.people_table(view(spark, d, VB))


_RATE = S.case_of("kind", V.DAYTIME_M2_PER_PERSON, 25)
PEOPLE = f"""people AS (SELECT *, CASE WHEN kind IN ('house', 'apartment') THEN floor_m2 / 45.0 ELSE 0.0 END::DOUBLE AS residents,
 CASE WHEN kind IN ('house', 'apartment', 'shed') THEN 0.0 ELSE floor_m2 / ({_RATE}) END::DOUBLE AS daytime
 FROM (SELECT *, w * h AS tiles, CAST(w * h * greatest(1, coalesce(levels, 1)) AS DOUBLE) AS floor_m2 FROM v_building) b)"""
CHUNKS = """chunk AS (SELECT x // 10 AS cx, y // 10 AS cy, sum((residents + daytime) / tiles) AS people FROM
 (SELECT p.*, x, y FROM people p, LATERAL (SELECT unnest(range(x0, x0 + w)) AS x) a, LATERAL (SELECT unnest(range(y0, y0 + h)) AS y) b) t GROUP BY 1, 2)"""
WATER = "water_tile AS (SELECT DISTINCT x + i AS tx, y + j AS ty FROM v_point, (SELECT unnest(range(12)) AS i) a, (SELECT unnest(range(12)) AS j) b WHERE use_value = 'machinery')"
GROUND = """ground AS (SELECT tx, ty, CASE WHEN max(o) = 2 THEN 2 ELSE 4 END AS value FROM (SELECT tx, ty, 2 AS o FROM road_tile UNION ALL SELECT tx, ty, 1 FROM water_tile) g GROUP BY tx, ty),
 share AS (SELECT tx // 10 AS cx, ty // 10 AS cy, count(*) FILTER (value = 2) / 100.0::DOUBLE AS paved, count(*) FILTER (value = 4) / 100.0::DOUBLE AS water FROM ground GROUP BY 1, 2)"""
BLUR = """tap AS (SELECT i - 2 AS o, [1, 4, 6, 4, 1][i + 1] / 16.0::DOUBLE AS k FROM (SELECT unnest(range(5)) AS i) q),
 raw AS (SELECT cx + a.o AS cx, cy + b.o AS cy, sum(people * a.k * b.k) AS soft FROM chunk, tap a, tap b WHERE cx + a.o >= 0 AND cy + b.o >= 0 GROUP BY 1, 2),
 blur AS (SELECT cx, cy, soft * (SELECT sum(people) FROM chunk) / (SELECT sum(soft) FROM raw) AS soft FROM raw)"""
SPAWN = """spawn AS (SELECT cx, cy, density, CAST(greatest(0, least(10, floor(v) + CASE WHEN (xor(cx * 73856093, cy * 19349663) % 1000003) / 1000003.0 < v - floor(v) THEN 1 ELSE 0 END)) AS INT) AS value
 FROM (SELECT *, round(density * 0.9, 9) AS v FROM (SELECT cx, cy, CASE WHEN coalesce(water, 0) > 0.5 THEN 0.0 ELSE 0.7 * coalesce(people, 0) + 0.3 * coalesce(soft, 0) + 1.3 * coalesce(paved, 0) END::DOUBLE AS density
  FROM chunk FULL JOIN blur USING (cx, cy) FULL JOIN share USING (cx, cy)) a) b)"""


def ground_tiles(spark, d):
    """Road tiles painted over ponds."""
    pond = view(spark, d, VP).where("use_value = 'machinery'") \
        .select(F.explode(F.sequence(c("x"), c("x") + 11)).alias("tx"), "y") \
        .select("tx", F.explode(F.sequence(c("y"), c("y") + 11)).alias("ty"))
    layers = road_tiles(spark, d).select("tx", "ty", F.lit(2).alias("value"), F.lit(2).alias("ord")) \
        .unionByName(pond.select("tx", "ty", F.lit(4).alias("value"), F.lit(1).alias("ord"))).withColumn("seq", F.lit(0))
    return L.painter_order(layers)


def ground_runs(spark, d):
    """The same as runs: eight tiles east of every road vertex, ponds of twelve by twelve."""
    roads = view(spark, d, VX).select(c("y").alias("ty"), c("x").alias("x0")).select("ty", "x0", (c("x0") + 8).alias("x1"), F.lit(1).alias("layer"))
    ponds = view(spark, d, VP).where("use_value = 'machinery'").select(F.explode(F.sequence(c("y"), c("y") + 11)).alias("ty"), c("x").alias("x0"), (c("x") + 12).alias("x1"), F.lit(0).alias("layer"))
    swept = PT.layered(roads.unionByName(ponds))
    return swept.select("ty", "x0", "x1", F.when(PT.has(c("layers"), 1), 2).otherwise(4).alias("value"))


def chunks(spark, d):
    return C.people_per_chunk(people(spark, d), c("residents") + c("daytime"), c("tiles"))


@query("occupants", f"WITH {PEOPLE} SELECT fid, round(residents, 6) AS residents, round(daytime, 6) AS daytime FROM people", [VB])
def occupants(spark, d):
    return people(spark, d).select("fid", F.round("residents", 6).alias("residents"), F.round("daytime", 6).alias("daytime"))


@query("people_per_chunk", f"WITH {PEOPLE}, {CHUNKS} SELECT cx, cy, round(people, 6) AS people FROM chunk", [VB])
def people_per_chunk(spark, d):
    return chunks(spark, d).select("cx", "cy", F.round("people", 6).alias("people"))


@query("ground_share_per_chunk", f"WITH {ROAD_TILES}, {WATER}, {GROUND} SELECT cx, cy, paved, water FROM share", [VX, VP])
def ground_share_per_chunk(spark, d):
    return C.ground_share_per_chunk(ground_runs(spark, d))


@query("blur_5tap", f"WITH {PEOPLE}, {CHUNKS}, {BLUR} SELECT cx, cy, round(soft, 6) AS people FROM blur", [VB])
def blur_5tap(spark, d):
    return C.blur_5tap(chunks(spark, d), "people").select("cx", "cy", F.round("people", 6).alias("people"))


def spawn(spark, d):
    return C.spawn_value(chunks(spark, d), C.ground_share_per_chunk(ground_runs(spark, d)))


@query("spawn_value", f"WITH {PEOPLE}, {CHUNKS}, {BLUR}, {ROAD_TILES}, {WATER}, {GROUND}, {SPAWN} SELECT cx, cy, round(density, 6) AS density, value FROM spawn", [VB, VX, VP])
def spawn_value(spark, d):
    return spawn(spark, d).select("cx", "cy", F.round("density", 6).alias("density"), "value")


@query("census_summary", f"""WITH {PEOPLE}, {CHUNKS}, {BLUR}, {ROAD_TILES}, {WATER}, {GROUND}, {SPAWN}
SELECT count(*) AS chunks, count(*) FILTER (value > 0) AS populated, max(value) AS peak, count(*) FILTER (value >= 10) AS at_cap, CAST(sum(value) AS BIGINT) AS spawn_total,
 (SELECT CAST(round(sum(residents)) AS BIGINT) FROM people) AS residents, (SELECT CAST(round(sum(daytime)) AS BIGINT) FROM people) AS daytime,
 round(count(*) FILTER (value > 0) / count(*), 4) AS share FROM spawn""", [VB, VX, VP])
def census_summary(spark, d):
    totals = people(spark, d).agg(F.sum("residents").alias("residents"), F.sum("daytime").alias("daytime"))
    return C.census_summary(spawn(spark, d), totals)


@query("density_grid", """WITH cell AS (SELECT CAST(floor((x0 + w / 2.0) / 40) AS BIGINT) AS gx, CAST(floor((y0 + h / 2.0) / 40) AS BIGINT) AS gy, sum(w * h) AS built FROM v_building GROUP BY 1, 2),
 o AS (SELECT unnest([-1, 0, 1]) AS o), m AS (SELECT max(gx) AS ex, max(gy) AS ey FROM cell)
SELECT gx, gy, round(least(1.0, built / ((1 + (gx > 0)::INT + (gx < ex)::INT) * (1 + (gy > 0)::INT + (gy < ey)::INT) * 1600.0)), 9)::DOUBLE AS coverage
FROM (SELECT gx + a.o AS gx, gy + b.o AS gy, sum(built)::DOUBLE AS built FROM cell, o a, o b GROUP BY 1, 2) q, m WHERE gx BETWEEN 0 AND ex AND gy BETWEEN 0 AND ey""", [VB])
def density_grid(spark, d):
    return C.density_grid(view(spark, d, VB)).select("gx", "gy", F.round("coverage", 9).alias("coverage"))


@query("town_zones", """SELECT * FROM (SELECT cx, cy, greatest(a - 8, cx * 300) AS tile_x, greatest(b - 8, cy * 300) AS tile_y,
 least(e + 8, cx * 300 + 300) - greatest(a - 8, cx * 300) AS width, least(f + 8, cy * 300 + 300) - greatest(b - 8, cy * 300) AS height
 FROM (SELECT x0 // 300 AS cx, y0 // 300 AS cy, min(x0) AS a, min(y0) AS b, max(x0 + w) AS e, max(y0 + h) AS f FROM v_building GROUP BY 1, 2) q) r WHERE width > 4 AND height > 4""", [VB])
def town_zones(spark, d):
    return C.town_zones(view(spark, d, VB))


@query("build_report", """SELECT CASE WHEN grouping(kind) = 0 THEN 'kind' WHEN grouping(storeys) = 0 THEN 'storeys' WHEN grouping(shape) = 0 THEN 'shape' ELSE 'total' END AS dimension,
 coalesce(kind, CAST(storeys AS VARCHAR), shape, 'all') AS item, count(*) AS n, count(levels) AS measured, round(100.0 * count(levels) / count(*), 4)::DOUBLE AS measured_pct
FROM (SELECT *, coalesce(levels, 1) AS storeys, CASE WHEN w >= 2 * h THEN 'row' ELSE 'block' END AS shape FROM v_building) b GROUP BY GROUPING SETS ((kind), (storeys), (shape), ())""", [VB])
def build_report(spark, d):
    b = view(spark, d, VB).withColumn("storeys", F.coalesce("levels", F.lit(1))) \
        .withColumn("shape", F.when(c("w") >= 2 * c("h"), F.lit("row")).otherwise(F.lit("block")))
    return C.build_report(b, ["kind", "storeys", "shape"]).withColumn("measured_pct", c("measured_pct").cast("double"))


@query("feature_bounds", "SELECT kind, min(x0) AS west, min(y0) AS north, max(x0 + w) AS east, max(y0 + h) AS south FROM v_building GROUP BY kind", [VB])
def feature_bounds(spark, d):
    return view(spark, d, VB).groupBy("kind").agg(F.min("x0").alias("west"), F.min("y0").alias("north"), F.max(c("x0") + c("w")).alias("east"), F.max(c("y0") + c("h")).alias("south"))


@query("member_bounds_or_null", """SELECT o_custkey AS rel_id, CASE WHEN count(*) = count(b) THEN min(b) END AS west, CASE WHEN count(*) = count(b) THEN max(b) END AS east
FROM (SELECT o_custkey, CASE WHEN o_totalprice > 20000 THEN o_orderkey % 1000 END AS b FROM orders) q GROUP BY 1""")
def member_bounds_or_null(spark, d):
    o = table(spark, d, "orders").select(c("o_custkey").alias("rel_id"), F.when(c("o_totalprice") > 20000, c("o_orderkey") % 1000).alias("b"))
    whole = F.count("*") == F.count("b")
    return o.groupBy("rel_id").agg(F.when(whole, F.min("b")).alias("west"), F.when(whole, F.max("b")).alias("east"))


COVERED = """covered AS (SELECT DISTINCT cx, cy FROM (SELECT y0, h, unnest(range(x0 // 40, (x0 + w) // 40 + 1)) AS cx FROM v_building) q, LATERAL (SELECT unnest(range(y0 // 40, (y0 + h) // 40 + 1)) AS cy) r)"""
GAPS = """extent AS (SELECT max((x0 + w) // 40) AS mx, max((y0 + h) // 40) AS my FROM v_building),
 gap AS (SELECT cx, cy FROM (SELECT unnest(range(mx + 1)) AS cx, my FROM extent) a, LATERAL (SELECT unnest(range(my + 1)) AS cy) b WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.cx = a.cx AND v.cy = b.cy))"""


def covered(spark, d):
    return J.feature_cells(view(spark, d, VB), "fid", 40).select("cx", "cy").distinct()


@query("covered_cells", f"WITH {COVERED} SELECT cx, cy FROM covered", [VB])
def covered_cells(spark, d):
    return covered(spark, d)


def gaps(spark, d):
    """Empty 40-tile cells of the map's own rectangle."""
    ext = view(spark, d, VB).agg(F.max(F.floor((c("x0") + c("w")) / 40)).alias("mx"), F.max(F.floor((c("y0") + c("h")) / 40)).alias("my"))
    grid = ext.select(F.explode(F.sequence(F.lit(0).cast("bigint"), c("mx"))).alias("cx"), "my").repartition("cx") \
        .select("cx", F.explode(F.sequence(F.lit(0).cast("bigint"), c("my"))).alias("cy"))
    return grid.join(covered(spark, d), ["cx", "cy"], "left_anti")


@query("gap_cells", f"WITH {COVERED}, {GAPS} SELECT cx, cy FROM gap", [VB])
def gap_cells(spark, d):
    return gaps(spark, d)


@query("gap_rects", f"""WITH {COVERED}, {GAPS}, runs AS (SELECT cy, min(cx) AS c0, max(cx) + 1 AS c1 FROM (SELECT cx, cy, cx - row_number() OVER (PARTITION BY cy ORDER BY cx) AS g FROM gap) q GROUP BY cy, g)
SELECT c0, min(cy) AS r0, c1, max(cy) + 1 AS r1 FROM (SELECT *, cy - row_number() OVER (PARTITION BY c0, c1 ORDER BY cy) AS g FROM runs) q GROUP BY c0, c1, g""", [VB])
def gap_rects(spark, d):
    from ..operators import tiles as R

    return R.cells_to_rects(gaps(spark, d))


# ------------------------------------------------------------------- roads
@query("vertex_degree", f"""WITH {SEGMENTS}, link AS (SELECT DISTINCT akey AS vkey, way_id, bkey AS other FROM seg WHERE akey <> bkey UNION SELECT DISTINCT bkey, way_id, akey FROM seg WHERE akey <> bkey)
SELECT vkey, count(*) AS links, count(*) >= 3 AS seed, NOT (count(*) = 2 AND count(DISTINCT way_id) = 1) AS cut FROM link GROUP BY vkey""", [VX])
def vertex_degree(spark, d):
    from ..operators import roads as R

    return R.vertex_degree(lattice_segments(spark, d))


@query("vertex_use_count", """SELECT vkey, CAST(sum(CASE WHEN pos = 1 OR pos = n THEN 2 ELSE 1 END) AS BIGINT) AS uses, sum(CASE WHEN pos = 1 OR pos = n THEN 2 ELSE 1 END) >= 2 AS node
FROM v_vertex JOIN (SELECT way_id, max(pos) AS n FROM v_vertex GROUP BY 1) q USING (way_id) GROUP BY vkey""", [VX])
def vertex_use_count(spark, d):
    from ..operators import roads as R

    return R.vertex_use_count(view(spark, d, VX))


@query("vertex_width", f"SELECT vkey, max(width)::DOUBLE AS width FROM (SELECT vkey, {S.case_of('category', V.ROAD_WIDTH_M)} AS width FROM v_vertex) q GROUP BY vkey", [VX])
def vertex_width(spark, d):
    from ..functions.text import lookup

    return view(spark, d, VX).groupBy("vkey").agg(F.max(lookup(c("category"), V.ROAD_WIDTH_M)).alias("width"))


@query("dominant_angle", f"""WITH {SEGMENTS}, s AS (SELECT sqrt((bx - ax) * (bx - ax) + (bv - ay) * (bv - ay)) AS len, 4 * atan2(CAST(ay - bv AS DOUBLE), CAST(bx - ax AS DOUBLE)) AS a FROM seg
 WHERE category IN ('road_minor', 'road_medium', 'road_service', 'pedestrian'))
SELECT round(degrees(atan2(sum(len * sin(a)), sum(len * cos(a))) / 4), 5) AS angle, round(sqrt(power(sum(len * sin(a)), 2) + power(sum(len * cos(a)), 2)) / sum(len), 6) AS strength FROM s WHERE len >= 1""", [VX])
def dominant_angle(spark, d):
    from ..operators import roads as R

    segs = lattice_segments(spark, d).where(c("category").isin(V.GRID_ROADS))
    return R.dominant_angle(segs).select(F.round("angle", 5).alias("angle"), F.round("strength", 6).alias("strength"))


# ------------------------------------------------------------------- tiles of regions
@query("region_areas", f"WITH {TILES}, owned AS (SELECT tx, ty, min(fid) AS fid FROM tile GROUP BY tx, ty) SELECT fid, count(*) AS tiles FROM owned GROUP BY fid", [VB])
def region_areas(spark, d):
    return owned_runs(spark, d).groupBy("fid").agg(F.sum(c("x1") - c("x0")).alias("tiles"))


@query("region_bounds", f"WITH {TILES}, owned AS (SELECT tx, ty, min(fid) AS fid FROM tile GROUP BY tx, ty) SELECT fid, min(tx) AS x0, min(ty) AS y0, max(tx) AS x1, max(ty) AS y1 FROM owned GROUP BY fid", [VB])
def region_bounds(spark, d):
    return owned_runs(spark, d).groupBy("fid").agg(F.min("x0").alias("x0"), F.min("ty").alias("y0"), (F.max("x1") - 1).alias("x1"), F.max("ty").alias("y1"))


@query("region_adjacency", f"""WITH {TILES}, owned AS (SELECT tx, ty, min(fid) AS fid FROM tile GROUP BY tx, ty)
SELECT least(p, q) AS a, greatest(p, q) AS b, count(*) AS edges FROM (SELECT a.fid AS p, b.fid AS q FROM owned a JOIN owned b ON b.tx = a.tx + 1 AND b.ty = a.ty AND a.fid <> b.fid
 UNION ALL SELECT a.fid, b.fid FROM owned a JOIN owned b ON b.tx = a.tx AND b.ty = a.ty + 1 AND a.fid <> b.fid) e GROUP BY 1, 2""", [VB])
def region_adjacency(spark, d):
    from ..operators import tiles as R

    return R.region_adjacency(owned_runs(spark, d), "fid")


@query("boundary_edges", f"""WITH {TILES}, on_tile AS (SELECT DISTINCT tx, ty FROM tile)
SELECT tx AS x, ty AS y, 'W' AS side FROM on_tile a WHERE NOT EXISTS (SELECT 1 FROM on_tile b WHERE b.tx = a.tx - 1 AND b.ty = a.ty)
UNION ALL SELECT tx + 1, ty, 'W' FROM on_tile a WHERE NOT EXISTS (SELECT 1 FROM on_tile b WHERE b.tx = a.tx + 1 AND b.ty = a.ty)
UNION ALL SELECT tx, ty, 'N' FROM on_tile a WHERE NOT EXISTS (SELECT 1 FROM on_tile b WHERE b.tx = a.tx AND b.ty = a.ty - 1)
UNION ALL SELECT tx, ty + 1, 'N' FROM on_tile a WHERE NOT EXISTS (SELECT 1 FROM on_tile b WHERE b.tx = a.tx AND b.ty = a.ty + 1)""", [VB])
def boundary_edges(spark, d):
    return PT.edges(PT.box_runs(view(spark, d, VB), []))


@query("tiles_by_cell", """SELECT x // 300 AS cx, y // 300 AS cy, count(*) AS n, min(x % 300) AS x0, min(y % 300) AS y0, max(x % 300) AS x1, max(y % 300) AS y1 FROM v_point GROUP BY 1, 2""", [VP])
def tiles_by_cell(spark, d):
    from ..operators import tiles as R

    return R.tiles_by_cell(view(spark, d, VP).select(c("x").alias("tx"), c("y").alias("ty")))


@query("house_stats", f"""WITH {TILES}, {PEOPLE}, m AS (SELECT fid, kind, tiles, coalesce(levels, 1) AS storeys, 2 * (w + h) AS wall FROM people)
SELECT kind, count(*) AS n, CAST(median(tiles) AS DOUBLE) AS median_tiles, round(avg(storeys), 6) AS mean_storeys, round(100.0 * count(*) FILTER (storeys > 1) / count(*), 4)::DOUBLE AS multi_pct, CAST(sum(wall) AS BIGINT) AS wall_edges
FROM m GROUP BY kind HAVING count(*) >= 5""", [VB])
def house_stats(spark, d):
    from ..operators import buildings as B

    return B.house_stats(view(spark, d, VB))


@query("piece_rollup", """SELECT x0 // 800 AS pc, y0 // 800 AS pr, count(*) AS features, count(*) FILTER (levels IS NULL) AS filled, arg_min(name, fid) FILTER (kind = 'shed') AS first_error FROM v_building GROUP BY 1, 2""", [VB])
def piece_rollup(spark, d):
    shed = c("kind") == "shed"
    return view(spark, d, VB).groupBy(F.floor(c("x0") / 800).alias("pc"), F.floor(c("y0") / 800).alias("pr")).agg(
        F.count("*").alias("features"), F.count_if(c("levels").isNull()).alias("filled"),
        F.min_by("name", F.when(shed, c("fid"))).alias("first_error"))


@query("official_population", """SELECT c_custkey AS id, c_name AS name, CAST(floor(c_acctbal * 10) AS BIGINT) AS population FROM customer WHERE c_acctbal > 0 ORDER BY population DESC, name, id LIMIT 5""")
def official_population(spark, d):
    p = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), F.floor(c("c_acctbal") * 10).alias("population"), (c("c_acctbal") > 0).alias("inside"))
    return C.official_population(p).drop("inside")


@query("map_cells", """SELECT cx, cy, count(DISTINCT fid) AS features FROM (SELECT fid, y0, h, unnest(range(x0 // 300, (x0 + w) // 300 + 1)) AS cx FROM v_building) q, LATERAL (SELECT unnest(range(y0 // 300, (y0 + h) // 300 + 1)) AS cy) r GROUP BY cx, cy""", [VB])
def map_cells(spark, d):
    return J.feature_cells(view(spark, d, VB), "fid").groupBy("cx", "cy").agg(F.count("*").alias("features")).orderBy("cy", "cx")


@query("call_rollup", """SELECT event_type AS func, count(*) AS calls, round(sum(value), 4) AS self_s, round(max(value), 4) AS cum_s, count(*) FILTER (user_id % 2 = 0) AS own_calls FROM events GROUP BY 1""")
def call_rollup(spark, d):
    return table(spark, d, "events").groupBy(c("event_type").alias("func")).agg(
        F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("self_s"), F.round(F.max("value"), 4).alias("cum_s"), F.count_if(c("user_id") % 2 == 0).alias("own_calls"))


@query("landmark_distinct", "SELECT name, use_value, min(pid) AS pid FROM v_point GROUP BY name, use_value", [VP])
def landmark_distinct(spark, d):
    return view(spark, d, VP).groupBy("name", "use_value").agg(F.min("pid").alias("pid"))


@query("label_table", """WITH top AS (SELECT fid AS id, name, 'building' AS kind FROM v_building WHERE kind IN ('shop', 'house', 'apartment', 'industrial', 'school') AND w * h >= 150 ORDER BY w * h DESC, fid LIMIT 40),
 every AS (SELECT * FROM top UNION ALL SELECT 1000000000 + aid, name, 'ground' FROM v_area WHERE side * side >= 400 AND category = 'cemetery'
  UNION ALL SELECT 1000000000 + aid, name, 'water' FROM v_area WHERE side * side >= 400 AND category = 'schoolyard'
  UNION ALL SELECT 2000000000 + n_nationkey, n_name, 'town' FROM nation)
SELECT id, CASE WHEN id % 6 = 0 THEN 'New ' || CAST(id AS VARCHAR) ELSE name END AS name, kind FROM every WHERE id % 10 <> 0""", [VB, VA])
def label_table(spark, d):
    a = view(spark, d, VA).select((c("aid") + 1000000000).alias("id"), "name", (c("side") * c("side")).alias("tiles"), "category")
    b = view(spark, d, VB).select(c("fid").alias("id"), "name", "kind", (c("w") * c("h")).alias("tiles"))
    towns = table(spark, d, "nation").select((c("n_nationkey") + 2000000000).cast("bigint").alias("id"), c("n_name").alias("name"), F.lit("town").alias("scale"))
    ids = b.select("id").unionByName(a.select("id")).unionByName(towns.select("id"))
    edits = ids.select("id", F.when(c("id") % 6 == 0, F.concat(F.lit("New "), c("id").cast("string"))).alias("name"), (c("id") % 10 == 0).alias("deleted"))
    return L.label_table(b, a.where("category = 'schoolyard'"), a.where("category = 'cemetery'"), towns, edits)
