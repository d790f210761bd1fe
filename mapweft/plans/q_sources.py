"""Queries of the scans, sinks and incremental forms, over text and boxes derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as P
from ..operators import pieces as PC
from ..operators import quality as Q
from ..operators import rings as R
from ..sources import readers as RD
from ..sources import writers as WR
from ..streaming import streams as ST
from . import sqltext as S
from .q_census import CHUNKS, PEOPLE, people
from .q_classify import draw
from .q_joins import SEGMENTS, lattice_segments
from .q_scalar import xy
from .registry import query
from .views import outlines, table, view

VB, VP, VA = "v_building", "v_point", "v_area"


def c(name):
    return F.col(name)


# ------------------------------------------------------------------- scans
@query("scan_osm_elements", """SELECT fid AS osm_id, CASE fid % 3 WHEN 0 THEN 'way' WHEN 1 THEN 'node' ELSE 'relation' END AS kind, name, CAST(CASE fid % 3 WHEN 0 THEN 2 ELSE 1 END AS INT) AS points FROM v_building WHERE fid % 7 <> 0""", [VB])
def scan_osm_elements(spark, d):
    """Buildings written as element JSON and parsed again; every seventh has no geometry."""
    b = view(spark, d, VB)
    pt = F.struct((c("y0") / 1000.0).alias("lat"), (c("x0") / 1000.0).alias("lon"))
    ok, k = c("fid") % 7 != 0, c("fid") % 3
    el = F.struct(F.when(k == 0, "way").when(k == 1, "node").otherwise("relation").alias("type"), c("fid").alias("id"),
                  F.when(ok & (k == 1), c("y0") / 1000.0).alias("lat"), F.when(ok & (k == 1), c("x0") / 1000.0).alias("lon"),
                  F.create_map(F.lit("name"), c("name")).alias("tags"), F.when(ok & (k == 0), F.array(pt, pt)).alias("geometry"),
                  F.when(k == 2, F.array(F.struct(F.lit("way").alias("type"), F.lit("outer").alias("role"), F.when(ok, F.array(pt)).alias("geometry")))).alias("members"))
    from ..model import ELEMENTS

    element = ELEMENTS["elements"].dataType.elementType
    raw = b.select(F.to_json(el).alias("j")).select(F.from_json("j", element).alias("el"))
    out = RD.parse_elements(raw)
    return out.select("osm_id", "kind", c("tags")["name"].alias("name"), F.size(c("rings")[0]["pts"]).alias("points"))


@query("scan_geojsonseq", """SELECT CASE WHEN fid % 5 = 0 THEN TRUE ELSE FALSE END AS made_id, 'way' AS kind, name, CAST(4 AS INT) AS points, count(*) AS n FROM v_building WHERE fid % 11 <> 0 GROUP BY 1, 2, 3, 4""", [VB])
def scan_geojsonseq(spark, d):
    b = view(spark, d, VB)
    sid = F.when(c("fid") % 5 == 0, F.lit("")).otherwise(F.format_string('"@id":"way/%d",', "fid"))
    line = F.format_string('\x1e{"type":"Feature","properties":{%s"name":"%s"},"geometry":{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]}}', sid, "name", "x0", "y0", c("x0") + c("w"), "y0", c("x0") + c("w"), c("y0") + c("h"), "x0", "y0")
    lines = b.select(F.when(c("fid") % 11 == 0, F.lit('{"type":"Feat')).otherwise(line).alias("value"))
    out = RD.parse_geojsonseq(lines)
    return out.groupBy((c("osm_id") < 0).alias("made_id"), "kind", c("tags")["name"].alias("name"), F.size(c("rings")[0]["pts"]).alias("points")).agg(F.count("*").alias("n"))


@query("scan_feature_table", "SELECT fid FROM v_building WHERE fid % 3 = 0", [VB])
def scan_feature_table(spark, d):
    b = view(spark, d, VB).withColumn("filters_version", F.when(c("fid") % 3 == 1, F.lit(11)).otherwise(F.lit(12)))
    for k in "swne":
        b = b.withColumn(f"box_{k}", F.when(c("fid") % 3 == 2, F.lit(0.5)).otherwise(F.lit(0.25)))
    return RD.scan_feature_table(b, (0.25, 0.25, 0.25, 0.25)).select("fid")


def footprints(spark, d):
    b = view(spark, d, VB)
    box = F.struct((c("x0") / 1000.0).alias("xmin"), ((c("x0") + c("w")) / 1000.0).alias("xmax"), (c("y0") / 1000.0).alias("ymin"), ((c("y0") + c("h")) / 1000.0).alias("ymax"))
    return b.select(c("fid").alias("id"), "kind", box.alias("bbox"))


@query("scan_buildings_bbox", """SELECT fid AS id FROM v_building b WHERE EXISTS (SELECT 1 FROM v_area a WHERE category = 'schoolyard' AND b.x0 <= a.x0 + side AND b.x0 + w >= a.x0 AND b.y0 <= a.y0 + side AND b.y0 + h >= a.y0)""", [VB, VA])
def scan_buildings_bbox(spark, d):
    boxes = view(spark, d, VA).where("category = 'schoolyard'").select((c("x0") / 1000.0).alias("xmin"), (c("y0") / 1000.0).alias("ymin"),
                                                                       ((c("x0") + c("side")) / 1000.0).alias("xmax"), ((c("y0") + c("side")) / 1000.0).alias("ymax"))
    return RD.scan_buildings_bbox(footprints(spark, d), boxes).select("id")


@query("prune_files_by_extent", """SELECT aid, name FROM v_area WHERE x0 <= 900 AND x0 + side >= 300 AND y0 <= 800 AND y0 + side >= 200""", [VA])
def prune_files_by_extent(spark, d):
    """The files whose extent meets a box; a reader is given their paths."""
    cat = view(spark, d, VA).select("aid", "name", c("x0").alias("xmin"), c("y0").alias("ymin"), (c("x0") + c("side")).alias("xmax"), (c("y0") + c("side")).alias("ymax"))
    return RD.files_in_extent(cat, (300, 200, 900, 800)).select("aid", "name")


@query("scan_extract_index", """SELECT 'r' || CAST(aid AS VARCHAR) AS id, CAST(x0 AS DOUBLE) AS w, CAST(x0 + side AS DOUBLE) AS e FROM v_area WHERE aid % 6 <> 0""", [VA])
def scan_extract_index(spark, d):
    a = view(spark, d, VA)
    ring = F.format_string('{"type":"Polygon","coordinates":[[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]]}', "x0", "y0", c("x0") + c("side"), "y0", c("x0") + c("side"), c("y0") + c("side"), "x0", "y0")
    box = F.array(*[v.cast("double") for v in (c("x0"), c("y0"), c("x0") + c("side"), c("y0") + c("side"))])
    f = F.struct(F.concat(F.lit("r"), c("aid").cast("string")).alias("id"), "name", F.lit(None).cast("string").alias("parent"), F.when(c("aid") % 6 != 0, F.lit("u")).alias("url"),
                 F.when(c("aid") % 2 == 0, box).alias("bbox"), ring.alias("geometry"))
    return RD.parse_extract_index(a.select(f.alias("f"))).select("id", "w", "e")


@query("scan_layer", """SELECT 'buildings' AS layer, 'b' || CAST(fid AS VARCHAR) AS fid, name FROM v_building UNION ALL SELECT 'areas', 'a' || CAST(aid AS VARCHAR), name FROM v_area UNION ALL SELECT 'places', 'p' || CAST(pid AS VARCHAR), name FROM v_point""", [VB, VA, VP])
def scan_layer(spark, d):
    def part(v, key, mark):
        return view(spark, d, v).select(F.concat(F.lit(mark), c(key).cast("string")).alias("fid"), "name")

    return RD.scan_layer({"buildings": part(VB, "fid", "b"), "areas": part(VA, "aid", "a"), "places": part(VP, "pid", "p")}).select("layer", "fid", "name")


@query("scan_placements", """SELECT 'h' || CAST(fid // 3 AS VARCHAR) || '.tbx' AS base, CAST(CASE WHEN fid % 3 > 0 THEN fid % 3 END AS INT) AS unit, CAST(x0 AS INT) AS tile_x, kind FROM v_building""", [VB])
def scan_placements(spark, d):
    unit = F.when(c("fid") % 3 > 0, F.format_string("_%02d", c("fid") % 3)).otherwise(F.lit(""))
    file = F.concat(F.lit("h"), F.floor(c("fid") / 3).cast("string"), unit, F.lit(".tbx"))
    line = F.concat_ws(",", file, c("name"), c("x0").cast("string"), c("y0").cast("string"), c("w").cast("string"), c("h").cast("string"), F.lit("0,0,0,0,1,0,1,1,0"), c("kind"), F.lit("brick,0,0.0"))
    return RD.parse_placements(view(spark, d, VB).select(line.alias("value"))).select("base", "unit", "tile_x", "kind")


@query("scan_class_plane", """SELECT aid, CAST(ty AS BIGINT) AS ty, CAST(0 AS BIGINT) AS x0, CAST(4 + aid % 5 AS BIGINT) AS x1, CAST(aid % 10 AS INT) AS value FROM v_area, (SELECT unnest(range(3)) AS ty) r WHERE aid % 9 <> 0""", [VA])
def scan_class_plane(spark, d):
    """One small plane per area; every ninth is cut short and skipped."""
    w = 4 + c("aid") % 5
    body = F.repeat(F.lpad(F.hex(c("aid") % 10), 2, "0"), F.when(c("aid") % 9 == 0, 5).otherwise((w * 3).cast("int")))
    content = F.unhex(F.concat(F.hex(F.lit("CLASSES1")), F.lpad(F.hex(w), 2, "0"), F.lit("000000"), F.lit("03000000"), body))
    files = view(spark, d, VA).select(c("aid").cast("string").alias("path"), content.alias("content"))
    return RD.parse_class_planes(files).select(c("path").cast("bigint").alias("aid"), "ty", "x0", "x1", "value")


# ------------------------------------------------------------------- sinks
def degree_boxes(spark, d):
    b = view(spark, d, VB)
    return b.select("fid", (c("y0") / 400.0).alias("s"), (c("x0") / 400.0).alias("w"), ((c("y0") + c("h") * (1 + c("fid") % 40)) / 400.0).alias("n"), ((c("x0") + c("w") * (1 + c("fid") % 40)) / 400.0).alias("e"))


DEG = "(SELECT fid, y0 / 400.0::DOUBLE AS s, x0 / 400.0::DOUBLE AS w, (y0 + h * (1 + fid % 40)) / 400.0::DOUBLE AS n, (x0 + w * (1 + fid % 40)) / 400.0::DOUBLE AS e FROM v_building)"


@query("sink_feature_grid", f"""WITH b AS (SELECT *, greatest(0, least(9, CAST(floor((s - 0.5) / 2.0 * 10) AS INT))) AS r0, greatest(0, least(9, CAST(floor((n - 0.5) / 2.0 * 10) AS INT))) AS r1,
 greatest(0, least(9, CAST(floor((w - 0.5) / 2.0 * 10) AS INT))) AS c0, greatest(0, least(9, CAST(floor((e - 0.5) / 2.0 * 10) AS INT))) AS c1 FROM {DEG} q WHERE NOT (n < 0.5 OR s > 2.5 OR e < 0.5 OR w > 2.5)),
 k AS (SELECT *, (r1 - r0 + 1) * (c1 - c0 + 1) > 32 OR (s <= 0.5 AND n >= 2.5 AND w <= 0.5 AND e >= 2.5) AS is_cover FROM b)
SELECT fid, is_cover, CAST(-1 AS INT) AS row, CAST(-1 AS INT) AS col FROM k WHERE is_cover UNION ALL
SELECT fid, is_cover, CAST(r AS INT), CAST(c AS INT) FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM k WHERE NOT is_cover) q, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c) t""", [VB])
def sink_feature_grid(spark, d):
    return WR.feature_grid(degree_boxes(spark, d), (0.5, 0.5, 2.5, 2.5)).select("fid", "is_cover", "row", "col")


REGION = f"""b AS (SELECT *, CAST(floor(s / 0.25) AS INT) AS r0, CAST(floor(n / 0.25) AS INT) AS r1, CAST(floor(w / 0.25) AS INT) AS c0, CAST(floor(e / 0.25) AS INT) AS c1 FROM {DEG} q)"""


@query("sink_region_grid", f"""WITH {REGION} SELECT fid, CAST(-1 AS INT) AS row, CAST(-1 AS INT) AS col FROM b WHERE r1 - r0 >= 4 OR c1 - c0 >= 4 UNION ALL
SELECT fid, CAST(r AS INT), CAST(c AS INT) FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM b WHERE r1 - r0 < 4 AND c1 - c0 < 4) q, LATERAL (SELECT unnest(range(c0, c1 + 1)) AS c) t""", [VB])
def sink_region_grid(spark, d):
    return WR.region_grid(degree_boxes(spark, d)).select("fid", "row", "col")


@query("scan_feature_grid", f"SELECT fid FROM {DEG} q WHERE NOT (n < 1.1 OR s > 1.9 OR e < 0.7 OR w > 1.3)", [VB])
def scan_feature_grid(spark, d):
    return RD.scan_feature_grid(WR.region_grid(degree_boxes(spark, d)), (1.1, 0.7, 1.9, 1.3), 0.25, ["fid"]).select("fid")


@query("sink_layers_geojson", """SELECT 'w' || CAST(fid AS VARCHAR) AS id, '{"type":"Feature","id":"w' || fid || '","properties":{"layer":"building","name":"' || name || '","kind":"' || kind || '"},"geometry":{"type":"Polygon","coordinates":[[['
 || x0 || ',' || y0 || '],[' || (x0 + w) || ',' || y0 || '],[' || (x0 + w) || ',' || (y0 + h) || '],[' || x0 || ',' || y0 || ']]]}}' AS json FROM v_building""", [VB])
def sink_layers_geojson(spark, d):
    x, y, w, h = c("x0"), c("y0"), c("w"), c("h")
    ring = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y))
    return WR.layer_features(view(spark, d, VB), F.concat(F.lit("w"), c("fid").cast("string")), "building", ["name", "kind"], ring)


@query("sink_junctions", """SELECT no, '{"id":' || no || ',"type":"' || use_value || '","centre":[' || x || ',' || y || ']}' AS json FROM (SELECT *, row_number() OVER (ORDER BY y, x) AS no FROM v_point) q""", [VP])
def sink_junctions(spark, d):
    return WR.junction_rows(view(spark, d, VP).select("x", "y", c("use_value").alias("type")))


@query("sink_piece_manifest", """SELECT 'town' AS parent, 'town__r' || r || '_c' || k AS name, r AS row, k AS col, k * 600 AS x0, r * 600 AS y0 FROM (SELECT CAST(ceil((max(x0 + w)) / 300.0) * 300 AS BIGINT) AS mw, CAST(ceil((max(y0 + h)) / 300.0) * 300 AS BIGINT) AS mh FROM v_building) e,
 LATERAL (SELECT unnest(range(CAST(ceil(mh / 600.0) AS BIGINT))) AS r) a, LATERAL (SELECT unnest(range(CAST(ceil(mw / 600.0) AS BIGINT))) AS k) b""", [VB])
def sink_piece_manifest(spark, d):
    ext = view(spark, d, VB).agg(P.ceil_to(F.max(c("x0") + c("w")), 300).alias("width"), P.ceil_to(F.max(c("y0") + c("h")), 300).alias("height"))
    return WR.piece_manifest(PC.piece_plan(ext, side=600), "town").select("parent", "name", "row", "col", "x0", "y0")


@query("sink_placements_csv", "SELECT 'b' || lpad(CAST(fid AS VARCHAR), 6, '0') || '.tbx' AS file, kind, x0 AS tile_x, y0 AS tile_y FROM v_building", [VB])
def sink_placements_csv(spark, d):
    rows = view(spark, d, VB).select(F.concat(F.lit("b"), F.lpad(c("fid").cast("string"), 6, "0"), F.lit(".tbx")).alias("file"), "kind", c("x0").alias("tile_x"), c("y0").alias("tile_y"))
    return WR.placement_rows(rows)


@query("sink_census_json", f"""WITH {PEOPLE} SELECT CAST(round(sum(residents)) AS BIGINT) AS residents, (SELECT '[' || string_agg('{{"name":"' || c_name || '","population":' || p || '}}', ',' ORDER BY p DESC, c_name) || ']'
 FROM (SELECT c_name, CAST(floor(c_acctbal * 10) AS BIGINT) AS p FROM customer WHERE c_acctbal > 0 ORDER BY p DESC, c_name LIMIT 5) t) AS official FROM people""", [VB])
def sink_census_json(spark, d):
    from ..operators import census as C

    p = table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name"), F.floor(c("c_acctbal") * 10).alias("population"), (c("c_acctbal") > 0).alias("inside"))
    summary = people(spark, d).agg(F.round(F.sum("residents")).cast("bigint").alias("residents"))
    return WR.census_json(summary, C.official_population(p))


@query("store_footprints", f"WITH {PEOPLE}, {CHUNKS} SELECT cx, cy, round(people, 6) AS people FROM chunk", [VB])
def store_footprints(spark, d):
    """The census from stored runs equals the one from rectangles."""
    from ..operators import census as C

    spans = WR.load_footprints(WR.footprint_rows(view(spark, d, VB)))
    res, day = C.occupants(c("kind"), c("tiles"), c("levels"))
    spans = spans.withColumn("people", res + day)
    return C.people_per_chunk(spans, c("people"), c("tiles")).select("cx", "cy", F.round("people", 6).alias("people"))


# ------------------------------------------------------------------- incremental
@query("trailing_rate_stream", """SELECT strftime(to_timestamp(s)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT event_type, value, unnest([h - 3 * 3600, h - 2 * 3600, h - 3600, h]) AS s FROM (SELECT *, CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS h FROM events) e) q GROUP BY 1, 2""".replace("to_timestamp(s)::TIMESTAMP", "make_timestamp(s * 1000000)"))
def trailing_rate_stream(spark, d):
    """The stream itself, read to its end."""
    out = ST.run_to_end(ST.trailing_rate(ST.read_table_stream(spark, d, "events")))
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("refresh_extract", """SELECT o_custkey AS region, strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS features FROM orders o WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders p WHERE p.o_custkey = o.o_custkey) GROUP BY 1, 2""")
def refresh_extract(spark, d):
    rows = table(spark, d, "orders").select(c("o_custkey").alias("region"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return ST.latest_extracts(rows, "region", "day").groupBy("region", "day").agg(F.count("*").alias("features"))


# ------------------------------------------------------------------- selections
@query("clip_classify", """SELECT fid, CASE WHEN bx > x0 AND bx + 2 < x0 + w AND bv > y0 AND bv + 2 < y0 + h THEN 'cover' WHEN bx > x0 + w OR bx + 2 < x0 OR bv > y0 + h OR bv + 2 < y0 THEN 'miss' ELSE 'hit' END AS outcome
FROM (SELECT *, x0 - 3 + fid % 29 AS bx, y0 - 3 + fid % 19 AS bv FROM v_building) q""", [VB])
def clip_classify(spark, d):
    x, y, w, h, f = c("x0"), c("y0"), c("w"), c("h"), c("fid")
    ring = F.array(xy(x, y), xy(x + w, y), xy(x + w, y + h), xy(x, y + h), xy(x, y))
    bx, by = (x - 3 + f % 29).cast("double"), (y - 3 + f % 19).cast("double")
    return view(spark, d, VB).select("fid", Q.clip_classify(ring, by, bx, by + 2, bx + 2).alias("outcome"))


# Two drawn shapes: a triangle and a crescent.
_DRAWN = {1: [(200.25, 200.25), (1500.35, 200.25), (200.25, 1500.35)],
          2: [(900.5, 900.5), (1400.5, 900.5), (1400.5, 1400.5), (900.5, 1400.5), (900.5, 1300.5), (1300.5, 1300.5), (1300.5, 1000.5), (900.5, 1000.5)]}
_DRAWN_EDGES = [(sid, *a, *b) for sid, pts in _DRAWN.items() for a, b in zip(pts, pts[1:] + pts[:1])]
_SIDE = "sign(({1}x - {0}x) * ({2}y - {0}y) - ({1}y - {0}y) * ({2}x - {0}x))"


@query("shape_filter", f"""WITH {SEGMENTS}, shape(sid, ax, ay, ex, ey) AS (SELECT * FROM (VALUES {', '.join(str(e) for e in _DRAWN_EDGES)})),
 e AS (SELECT * FROM v_outline WHERE ring = 0),
 line AS (SELECT fid, (max(CASE WHEN ay <= mid THEN ay END) + min(CASE WHEN ay > mid THEN ay END)) / 2.0 AS y FROM e JOIN (SELECT fid, (min(ay) + max(ay)) / 2.0 AS mid FROM e GROUP BY fid) m USING (fid) GROUP BY fid),
 hit AS (SELECT fid, y, ax + (y - ay) * (ex - ax) / (ey - ay)::DOUBLE AS x FROM e JOIN line USING (fid) WHERE (ay > y) <> (ey > y)),
 span AS (SELECT fid, y, x AS x1, lead(x) OVER p AS x2, row_number() OVER p AS i FROM hit WINDOW p AS (PARTITION BY fid ORDER BY x)),
 spot AS (SELECT fid, arg_min((x1 + x2) / 2.0, (x1 - x2, x1)) AS x, min(y) AS y FROM span WHERE i % 2 = 1 GROUP BY fid),
 place AS (SELECT 'area' AS kind, fid AS id, x, y FROM spot UNION ALL SELECT 'point', pid, x, y FROM v_point UNION ALL SELECT 'line', way_id, arg_min(x, pos), arg_min(y, pos) FROM v_vertex GROUP BY way_id),
 s AS (SELECT way_id, ax AS px, ay AS py, bx AS qx, bv AS qy FROM seg), w AS (SELECT ax AS ux, ay AS uy, ex AS vx, ey AS vy FROM shape)
SELECT kind, id FROM {S.ring_hits("(SELECT kind || id AS k, x, y FROM place)", "shape", "k", "sid")} h JOIN (SELECT kind || id AS k, kind, id FROM place) p USING (k) WHERE inside
UNION SELECT 'line', way_id FROM s, w WHERE least(px, qx) <= greatest(ux, vx) AND least(ux, vx) <= greatest(px, qx) AND least(py, qy) <= greatest(uy, vy) AND least(uy, vy) <= greatest(py, qy)
 AND {_SIDE.format('u', 'v', 'p')} * {_SIDE.format('u', 'v', 'q')} <= 0 AND {_SIDE.format('p', 'q', 'u')} * {_SIDE.format('p', 'q', 'v')} <= 0""", [VB, VP, "v_vertex", "v_outline"])
def shape_filter(spark, d):
    """Features of drawn shapes: areas by a place inside them, lines that meet a shape, points within."""
    shapes = spark.createDataFrame([(sid, *map(float, e)) for sid, *e in _DRAWN_EDGES], "sid int, ax double, ay double, bx double, by double")
    spots = R.interior_points(outlines(spark, d, "v_outline").where("ring = 0"), "fid").select(F.lit("area").alias("kind"), c("fid").alias("id"), "x", "y")
    points = view(spark, d, "v_point").select(F.lit("point").alias("kind"), c("pid").alias("id"), "x", "y")
    # A way of one vertex is a point.
    single = view(spark, d, "v_vertex").groupBy(c("way_id").alias("id")).agg(F.count("*").alias("n"), F.min("x").alias("x"), F.min("y").alias("y")).where("n = 1")
    points = points.unionByName(single.select(F.lit("line").alias("kind"), "id", "x", "y"))
    lines = lattice_segments(spark, d).select(F.lit("line").alias("kind"), c("way_id").alias("id"), "pos", c("ax").alias("px"), c("ay").alias("py"), c("bx").alias("qx"), c("by").alias("qy"))
    return R.in_any_shape(spots.unionByName(points), lines, shapes)


_SHOPTAG = "CASE fid % 5 WHEN 0 THEN 'retail' WHEN 1 THEN 'yes' WHEN 2 THEN 'house' WHEN 3 THEN 'shed' ELSE '' END"
_TAGGED = "CASE fid % 6 WHEN 0 THEN 'shop' WHEN 1 THEN 'house' END"
_LAND = "CASE fid % 7 WHEN 0 THEN 'shop' WHEN 1 THEN 'industrial' END"
_OVER = "CASE WHEN fid % 31 = 0 THEN 'school' END"


@query("resolve_building_kind", f"""WITH a AS (SELECT *, {_SHOPTAG} AS btag, {_TAGGED} AS tagged, {_LAND} AS land, {_OVER} AS over, fid % 8 = 0 AS uses, fid % 16 = 0 AS offices, w * h AS m2, coalesce(levels, 2) AS lv, CASE WHEN fid % 9 < 4 THEN fid % 9 END AS nearby, fid % 10 = 3 AS zoned, CASE WHEN fid % 20 = 3 THEN 'military' END AS zone, fid % 37 = 0 AS hotel, fid % 24 = 8 AS stage FROM v_building),
 b AS (SELECT *, CASE WHEN uses AND offices AND (tagged IS NULL OR tagged = 'house') THEN 'civic' WHEN uses AND NOT offices AND (tagged IS NULL OR tagged IN ('house', 'shed')) THEN 'shop' ELSE tagged END AS k1 FROM a),
 c AS (SELECT *, CASE WHEN k1 IS NOT NULL THEN k1 WHEN btag = 'shed' OR (btag IN ('', 'yes') AND m2 <= 30) THEN 'shed' WHEN nearby >= 3 AND m2 >= 60 AND btag <> 'house' THEN 'apartment' WHEN land = 'shop' AND lv >= 3 THEN NULL ELSE land END AS k2 FROM b),
 e AS (SELECT *, CASE WHEN over IS NOT NULL THEN over WHEN tagged IS NULL AND zoned THEN zone ELSE k2 END AS k3 FROM c),
 f AS (SELECT *, CASE WHEN k3 IS NULL AND (lv >= 3 OR (lv <> 1 AND m2 >= 150 AND btag <> 'house' AND {S.draw('fid', 'x0', 9)} < 0.55)) THEN 'apartment' ELSE k3 END AS k4 FROM e)
SELECT fid, CASE WHEN over IS NOT NULL THEN k4 WHEN hotel THEN 'apartment' WHEN stage THEN 'civic' WHEN k4 IN ('shop', 'restaurant') AND uses AND lv >= 3 AND btag NOT IN ('retail', 'commercial', 'supermarket', 'shop', 'kiosk') THEN CASE WHEN offices THEN 'civic' ELSE 'apartment' END ELSE k4 END AS kind FROM f""", [VB])
def resolve_building_kind(spark, d):
    from ..operators import resolve as RS

    f = c("fid")
    b = view(spark, d, VB).select("fid", "x0", (c("w") * c("h")).alias("m2"), F.coalesce("levels", F.lit(2)).alias("levels"), F.expr(_SHOPTAG).alias("btag"), F.expr(_TAGGED).alias("tagged"), F.expr(_LAND).alias("land"),
                                  F.expr(_OVER).alias("override"), (f % 8 == 0).alias("has_uses"), (f % 16 == 0).alias("offices_only"), F.when(f % 9 < 4, f % 9).alias("nearby"), (f % 10 == 3).alias("zoned"),
                                  F.when(f % 20 == 3, F.lit("military")).alias("zone_kind"), (f % 37 == 0).alias("hotel"), (f % 24 == 8).alias("theatre"))
    return RS.resolve_building_kind(b.withColumn("draw", draw("fid", "x0", 9))).select("fid", "kind")


