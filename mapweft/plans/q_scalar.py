"""Queries of the scalar functions: text, dates, mathematics, arrays, maps and JSON."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo as P
from ..functions import project as U
from ..functions import shapes as H
from ..functions import tables as V
from ..functions import text as X
from . import sqltext as S
from .registry import query
from .views import pick, table, tagged, view

VT, VB = ["v_tagged"], ["v_building"]


def c(name):
    return F.col(name)


def r(col, n=6):
    return F.round(col, n)


def xy(x, y):
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


# ------------------------------------------------------------------- text
@query("parse_measure", f"SELECT id, {S.measure('height')} AS metres FROM v_tagged", VT)
def parse_measure(spark, d):
    return tagged(spark, d).select("id", X.parse_measure(c("t")["height"]).alias("metres"))


@query("leading_number", f"SELECT id, coalesce({S.first_number('width')}, {S.first_number('lanes')}) AS number FROM v_tagged", VT)
def leading_number(spark, d):
    return tagged(spark, d).select("id", X.leading_number(c("t")["width"], c("t")["lanes"]).alias("number"))


_POP = pick("c_custkey % 6", ["12,345", "1 200; 2019", "980", "about 40", "3.5"])


@query("parse_population", f"""SELECT c_custkey, CASE WHEN regexp_full_match(raw, '[0-9]+') THEN TRY_CAST(raw AS BIGINT) END AS population
FROM (SELECT c_custkey, regexp_replace(split_part({_POP}, ';', 1), '[, ]', '', 'g') AS raw FROM customer) q""")
def parse_population(spark, d):
    df = table(spark, d, "customer").selectExpr("c_custkey", f"{_POP} AS raw")
    return df.select("c_custkey", X.parse_population(c("raw")).alias("population"))


@query("species_tokens", """SELECT id, token FROM (SELECT id, unnest(list_distinct(list_filter(
 string_split(replace(replace(lower(wood), ',', ' '), ';', ' '), ' '), lambda w: w <> ''))) AS token FROM v_tagged WHERE wood IS NOT NULL) q""", VT)
def species_tokens(spark, d):
    return tagged(spark, d).select("id", F.explode(X.species_tokens(c("t")["wood"])).alias("token"))


_VER = "CASE event_id % 4 WHEN 0 THEN '1.' || CAST(event_id % 12 AS VARCHAR) WHEN 1 THEN 'v1.3.' || CAST(event_id % 15 AS VARCHAR) WHEN 2 THEN '' ELSE '2.0.1.7.9' END"


@query("version_key", f"""SELECT event_id, CAST(coalesce(k[1], 0) AS INT) AS major, CAST(coalesce(k[2], -1) AS INT) AS minor, CAST(coalesce(k[4], -1) AS INT) AS fourth
FROM (SELECT event_id, list_transform(regexp_extract_all({_VER}, '[0-9]+')[1:4], lambda s: CAST(s AS INT)) AS k FROM events) q""")
def version_key(spark, d):
    df = table(spark, d, "events").selectExpr("event_id", _VER.replace("VARCHAR", "STRING") + " AS v").withColumn("k", X.version_key(c("v")))
    return df.select("event_id", F.get("k", F.lit(0)).alias("major"), F.coalesce(F.get("k", F.lit(1)), F.lit(-1)).alias("minor"),
                     F.coalesce(F.get("k", F.lit(3)), F.lit(-1)).alias("fourth"))


@query("safe_name", "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), 60) AS slug FROM pages")
def safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", X.safe_name(c("url")).alias("slug"))


@query("piece_name", "SELECT fid, name || '__r' || CAST(y0 // 300 AS VARCHAR) || '_c' || CAST(x0 // 300 AS VARCHAR) AS piece FROM v_building", VB)
def piece_name(spark, d):
    return view(spark, d, "v_building").select("fid", X.piece_name(c("name"), P.cell_of(c("y0")), P.cell_of(c("x0"))).alias("piece"))


@query("redact_user", r"""SELECT doc_id, sha256(regexp_replace(regexp_replace('C:\Users\' || source || '\maps ' || text,
 '(?i)([\\/]Users[\\/])[^\\/\s"'']+', '\1<you>', 'g'), '(?i)web', '<you>', 'g')) AS masked FROM documents""")
def redact_user(spark, d):
    line = F.concat(F.lit("C:\\Users\\"), c("source"), F.lit("\\maps "), c("text"))
    return table(spark, d, "documents").select("doc_id", F.sha2(X.redact_user(line, user="web"), 256).alias("masked"))


_SPACE = r"'[ \t\n\v\f\r]+'"


@query("error_text", rf"""SELECT page_id, CASE WHEN contains(lower(left(html, 400)), '<html') AND said <> '' THEN said ELSE left(plain, 400) END AS said
FROM (SELECT *, left(array_to_string(CASE WHEN len(errs) > 0 THEN errs ELSE texts END, ' | '), 400) AS said
 FROM (SELECT *, list_filter(texts, lambda p: contains(lower(p), 'error')) AS errs
  FROM (SELECT page_id, html, trim(regexp_replace(html, {_SPACE}, ' ', 'g')) AS plain,
   list_filter(list_transform(regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1),
     lambda p: trim(regexp_replace(regexp_replace(p, '(?s)<[^>]+>', ' ', 'g'), {_SPACE}, ' ', 'g'))),
     lambda p: p <> '' AND NOT contains(lower(p), 'openstreetmap.org')) AS texts FROM pages) a) b) c""")
def error_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.error_text(c("html")).alias("said"))


@query("name_override", """SELECT aid, CASE WHEN aid % 13 = 0 THEN NULL
 ELSE coalesce(CASE WHEN aid % 5 = 0 THEN 'Way ' || CAST(aid AS VARCHAR) END, CASE WHEN aid % 4 = 0 THEN 'New ' || name END, name) END AS shown FROM v_area""", ["v_area"])
def name_override(spark, d):
    own = F.when(c("aid") % 5 == 0, F.concat(F.lit("Way "), c("aid").cast("string")))
    renamed = F.when(c("aid") % 4 == 0, F.concat(F.lit("New "), c("name")))
    return view(spark, d, "v_area").select("aid", X.name_override(c("name"), own, renamed, c("aid") % 13 == 0).alias("shown"))


@query("needs_refresh", """SELECT o_orderkey, NOT coalesce(o_orderdate <= CASE WHEN o_orderkey % 7 > 0 THEN TIMESTAMP '1997-01-01' END, FALSE) AS pending FROM orders""")
def needs_refresh(spark, d):
    built = F.when(c("o_orderkey") % 7 > 0, F.to_timestamp(F.lit("1997-01-01T00:00:00")))
    return table(spark, d, "orders").select("o_orderkey", X.needs_refresh(c("o_orderdate"), built).alias("pending"))


@query("first_tag_key", f"""SELECT id, CASE WHEN amenity IS NOT NULL THEN 'amenity' WHEN shop IS NOT NULL THEN 'shop' WHEN leisure IS NOT NULL THEN 'leisure'
 WHEN tourism IS NOT NULL THEN 'tourism' WHEN historic IS NOT NULL THEN 'historic' WHEN office IS NOT NULL THEN 'office'
 WHEN healthcare IS NOT NULL THEN 'healthcare' WHEN building NOT IN ({", ".join(S.lit(v) for v in V.BORING_BUILDING_VALUES)}) THEN 'building' END AS key FROM v_tagged""", VT)
def first_tag_key(spark, d):
    return tagged(spark, d).select("id", X.landmark_key(c("t")).alias("key"))


@query("tag_pairs", """SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events""")
def tag_pairs(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(X.tag_pairs(c("props"))))


# ------------------------------------------------------------------- grids and boxes
LAT, LON = "(40.0 + (fid * 7919 % 10000) / 100000.0)", "(20.0 + (fid * 104729 % 10000) / 100000.0)"
LAT2, LON2 = f"({LAT} + (fid % 90 + 1) / 10000.0)", f"({LON} + (fid % 70 + 1) / 10000.0)"


def points(spark, d):
    """Buildings as boxes in degrees."""
    df = view(spark, d, "v_building")
    return df.selectExpr("fid", f"{LAT} AS s", f"{LON} AS w", f"{LAT2} AS n", f"{LON2} AS e")


_BOX = f"(SELECT fid, {LAT}::DOUBLE AS s, {LON}::DOUBLE AS w, {LAT2}::DOUBLE AS n, {LON2}::DOUBLE AS e FROM v_building)"


def boxes(spark, d):
    return points(spark, d).select("fid", *[c(k).cast("double").alias(k) for k in "swne"])


@query("metres_between", f"""SELECT fid, round(sqrt(power((n - s) * 111320.0, 2) + power((e - w) * 111320.0 * cos(radians((s + n) / 2.0)), 2)), 4) AS metres FROM {_BOX} b""", VB)
def metres_between(spark, d):
    return boxes(spark, d).select("fid", r(P.metres_between(c("s"), c("w"), c("n"), c("e")), 4).alias("metres"))


@query("area_km2", f"SELECT fid, round((n - s) * 111.32 * (e - w) * 111.32 * cos(radians((s + n) / 2.0)), 6) AS km2 FROM {_BOX} b", VB)
def area_km2(spark, d):
    return boxes(spark, d).select("fid", r(P.area_km2(c("s"), c("w"), c("n"), c("e"))).alias("km2"))


@query("wrap_lon", "SELECT fid, CAST((fid * 7 % 1440 - 720 + 900) % 360 - 180 AS DOUBLE) AS lon FROM v_building", VB)
def wrap_lon(spark, d):
    return view(spark, d, "v_building").select("fid", P.wrap_lon((c("fid") * 7 % 1440 - 720).cast("double")).alias("lon"))


@query("normalise_bbox", """SELECT fid, w2 AS w, e2 AS e, CASE WHEN s2 >= n2 OR w2 = e2 THEN 'degenerate' WHEN w2 > e2 THEN 'antimeridian' END AS problem
FROM (SELECT fid, greatest(-85.05, least(85.05, s)) AS s2, greatest(-85.05, least(85.05, n)) AS n2,
 (w + 900) % 360 - 180 AS w2, (e + 900) % 360 - 180 AS e2
 FROM (SELECT fid, CAST(fid % 200 - 100 AS DOUBLE) AS s, CAST(fid % 190 - 90 AS DOUBLE) AS n, CAST(fid * 7 % 1440 - 720 AS DOUBLE) AS w,
        CAST(fid * 7 % 1440 - 720 + fid % 30 AS DOUBLE) AS e FROM v_building) a) b""", VB)
def normalise_bbox(spark, d):
    f = c("fid")
    box = P.normalise_bbox((f % 200 - 100).cast("double"), (f * 7 % 1440 - 720).cast("double"),
                           (f % 190 - 90).cast("double"), (f * 7 % 1440 - 720 + f % 30).cast("double"))
    return view(spark, d, "v_building").select("fid", box.alias("b")).select("fid", "b.w", "b.e", "b.problem")


@query("bbox_for_cells", f"""SELECT fid, round(greatest(-90.0, s - dlat), 8) AS s, round(greatest(-180.0, w - dlat / greatest(0.2, cos(radians((s + n) / 2.0)))), 8) AS w
FROM (SELECT *, 600.0 / 111320.0 AS dlat FROM {_BOX} a) b""", VB)
def bbox_for_cells(spark, d):
    box = P.bbox_for_cells(c("s"), c("w"), c("n"), c("e"), 2.0)
    return boxes(spark, d).select("fid", box.alias("b")).select("fid", r(c("b.s"), 8).alias("s"), r(c("b.w"), 8).alias("w"))


@query("ceil_to", "SELECT fid, CAST(ceil(x0 / 300.0) * 300 AS BIGINT) AS up FROM v_building", VB)
def ceil_to(spark, d):
    return view(spark, d, "v_building").select("fid", P.ceil_to(c("x0"), 300).alias("up"))


@query("cell_of", "SELECT fid, CAST(x0 // 300 AS INT) AS cx, CAST(y0 // 300 AS INT) AS cy FROM v_building", VB)
def cell_of(spark, d):
    return view(spark, d, "v_building").select("fid", P.cell_of(c("x0")).alias("cx"), P.cell_of(c("y0")).alias("cy"))


@query("offset_in_cell", "SELECT fid, x0 % 300 AS ox, y0 % 300 AS oy FROM v_building", VB)
def offset_in_cell(spark, d):
    return view(spark, d, "v_building").select("fid", P.offset_in_cell(c("x0")).alias("ox"), P.offset_in_cell(c("y0")).alias("oy"))


@query("keyed_draw", f"SELECT fid, xor(x0 * 73856093, y0 * 19349663) AS hash, {S.draw('fid', 'x0', 3)} AS u FROM v_building", VB)
def keyed_draw(spark, d):
    from ..functions.tags import spatial_hash
    from .q_classify import draw

    return view(spark, d, "v_building").select("fid", spatial_hash(c("x0"), c("y0")).alias("hash"), draw("fid", "x0", 3).alias("u"))


# ------------------------------------------------------------------- projection
GRID = U.build_grid(40.0, 20.0, 40.1, 20.1, 2.0, rotation=30.0)


def _utm_sql(lat, lon):
    """Easting and northing of zone 34 north bv the same series, in SQL functions."""
    t = f"sinh(atanh(sin(radians({lat}))) - {U._ECC!r} * atanh({U._ECC!r} * sin(radians({lat}))))"
    lam = f"radians({lon} - 21.0)"
    xi, eta = f"atan2({t}, cos({lam}))", f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    k = U.SCALE * U._RADIUS
    east = f"(500000.0 + {k!r} * (eta + " + " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(U._ALPHA, 1)) + "))"
    north = f"({k!r} * (xi + " + " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(U._ALPHA, 1)) + "))"
    return xi, eta, east, north


_XI, _ETA, _EAST, _NORTH = _utm_sql("s", "w")
_A = math.radians(30.0)


@query("project_utm", f"""SELECT fid, round((rx - {GRID.min_x!r}) / 2.0, 3) AS px, round({GRID.height} - (ry - {GRID.min_y!r}) / 2.0, 3) AS py
FROM (SELECT fid, {GRID.rot_x!r} + dx * {math.cos(_A)!r} - dy * {math.sin(_A)!r} AS rx, {GRID.rot_y!r} + dx * {math.sin(_A)!r} + dy * {math.cos(_A)!r} AS ry
 FROM (SELECT fid, {_EAST} - {GRID.rot_x!r} AS dx, {_NORTH} - {GRID.rot_y!r} AS dy
  FROM (SELECT fid, {_XI} AS xi, {_ETA} AS eta FROM {_BOX} a) b) c) d""", VB)
def project_utm(spark, d):
    px, py = U.project_utm(c("s"), c("w"), GRID)
    return boxes(spark, d).select("fid", r(px, 3).alias("px"), r(py, 3).alias("py"))


@query("unproject_utm", f"SELECT fid, round(s, 7) AS lat, round(w, 7) AS lon FROM {_BOX} a", VB)
def unproject_utm(spark, d):
    px, py = U.project_utm(c("s"), c("w"), GRID)
    there = boxes(spark, d).select("fid", px.alias("px"), py.alias("py"))
    lat, lon = U.unproject_utm(c("px"), c("py"), GRID)
    return there.select("fid", r(lat, 7).alias("lat"), r(lon, 7).alias("lon"))


@query("cover_bbox", f"SELECT count(*) AS inside, count(*) AS total FROM {_BOX} a", VB)
def cover_bbox(spark, d):
    s, w, n, e = U.cover_bbox(GRID)
    inside = P.box_has_point(s, w, n, e, c("s"), c("w"))
    return boxes(spark, d).agg(F.count_if(inside).alias("inside"), F.count("*").alias("total"))


# ------------------------------------------------------------------- rings: a slanted quad per building
def quads(spark, d):
    x, y, w, h, f = c("x0"), c("y0"), c("w"), c("h"), c("fid")
    ring = F.array(xy(x, y), xy(x + w, y + f % 3), xy(x + w, y + h), xy(x + f % 2, y + h))
    return view(spark, d, "v_building").select("fid", "x0", "y0", "w", "h", ring.alias("pts"))


_QUAD = """(SELECT fid, CAST(x0 AS DOUBLE) AS ax, CAST(y0 AS DOUBLE) AS ay, CAST(x0 + w AS DOUBLE) AS bx, CAST(y0 + fid % 3 AS DOUBLE) AS bv,
 CAST(x0 + w AS DOUBLE) AS cx, CAST(y0 + h AS DOUBLE) AS cy, CAST(x0 + fid % 2 AS DOUBLE) AS dx, CAST(y0 + h AS DOUBLE) AS dy, w, h FROM v_building)"""
_SHOELACE = "abs(ax * bv - bx * ay + bx * cy - cx * bv + cx * dy - dx * cy + dx * ay - ax * dy) / 2.0"


@query("ring_area", f"SELECT fid, {_SHOELACE} AS area FROM {_QUAD} q", VB)
def ring_area(spark, d):
    return quads(spark, d).select("fid", P.ring_area(c("pts")).alias("area"))


@query("area_m2", f"""SELECT fid, round(111320.0 * 111320.0 * cos(radians((s + s + n + n) / 4)) * (n - s) * (e - w), 2) AS m2 FROM {_BOX} q""", VB)
def area_m2(spark, d):
    ring = F.array(xy(c("w"), c("s")), xy(c("e"), c("s")), xy(c("e"), c("n")), xy(c("w"), c("n")))
    return boxes(spark, d).select("fid", r(P.area_m2(ring), 2).alias("m2"))


@query("shape_area_deg2", f"SELECT fid, round(2 * (n - s) * (e - w), 9) AS deg2 FROM {_BOX} q", VB)
def shape_area_deg2(spark, d):
    ring = F.array(xy(c("w"), c("s")), xy(c("e"), c("s")), xy(c("e"), c("n")), xy(c("w"), c("n")), xy(c("w"), c("s")))
    return boxes(spark, d).select("fid", r(P.shape_area_deg2(F.array(F.array(ring), F.array(ring, ring))), 9).alias("deg2"))


def _cross(ax, ay, bx, bv):
    return f"((({ay} > py) <> ({bv} > py)) AND coalesce(px < ({bx} - {ax}) * (py - {ay}) / nullif({bv} - {ay}, 0) + {ax}, FALSE))::INT"


_PIP = f"(({_cross('ax', 'ay', 'bx', 'bv')} + {_cross('bx', 'bv', 'cx', 'cy')} + {_cross('cx', 'cy', 'dx', 'dy')} + {_cross('dx', 'dy', 'ax', 'ay')}) % 2 = 1)"


@query("point_in_ring", f"SELECT fid, {_PIP} AS inside FROM (SELECT *, ax + fid % 25 AS px, ay + fid % 17 AS py FROM {_QUAD} a) q", VB)
def point_in_ring(spark, d):
    f = c("fid")
    return quads(spark, d).select("fid", P.point_in_ring(c("pts"), (c("x0") + f % 25).cast("double"), (c("y0") + f % 17).cast("double")).alias("inside"))


# A segment meets a box unless it lies wholly to one side of it or of its own line.
@query("segment_hits_box", """SELECT fid, NOT (greatest(x1, x2) < bx0 OR least(x1, x2) > bx1 OR greatest(y1, y2) < by0 OR least(y1, y2) > by1
 OR (s00 > 0 AND s01 > 0 AND s10 > 0 AND s11 > 0) OR (s00 < 0 AND s01 < 0 AND s10 < 0 AND s11 < 0)) AS hit
FROM (SELECT *, (y2 - y1) * (bx0 - x1) - (x2 - x1) * (by0 - y1) AS s00, (y2 - y1) * (bx1 - x1) - (x2 - x1) * (by0 - y1) AS s10,
   (y2 - y1) * (bx0 - x1) - (x2 - x1) * (by1 - y1) AS s01, (y2 - y1) * (bx1 - x1) - (x2 - x1) * (by1 - y1) AS s11
 FROM (SELECT fid, x0 AS bx0, y0 AS by0, x0 + w AS bx1, y0 + h AS by1, x0 - 8 + fid % 11 AS x1, y0 - 6 + fid % 13 AS y1,
   x0 + fid % 31 AS x2, y0 + fid % 23 - 3 AS y2 FROM v_building) a) b""", VB)
def segment_hits_box(spark, d):
    f, x, y = c("fid"), c("x0"), c("y0")
    n = [v.cast("double") for v in (y - 6 + f % 13, x - 8 + f % 11, y + f % 23 - 3, x + f % 31, y, x, y + c("h"), x + c("w"))]
    return view(spark, d, "v_building").select("fid", P.segment_hits_box(*n).alias("hit"))


@query("point_line_distance", f"""SELECT fid, round(abs((cx - ax) * (ay - py) - (ax - px) * (cy - ay)) / sqrt(power(cx - ax, 2) + power(cy - ay, 2)), 6) AS dist
FROM (SELECT *, ax + fid % 25 AS px, ay + fid % 17 AS py FROM {_QUAD} a) q""", VB)
def point_line_distance(spark, d):
    a, b = c("pts")[0], c("pts")[2]
    f = c("fid")
    return quads(spark, d).select("fid", r(P.point_line_distance(c("x0") + f % 25, c("y0") + f % 17, a["x"], a["y"], b["x"], b["y"])).alias("dist"))


@query("project_on_segment", f"""SELECT fid, round(t, 6) AS t, round(sqrt(power(px - bx * t, 2) + power(py - bv * t, 2)), 4) AS metres
FROM (SELECT *, greatest(0.0, least(1.0, (px * bx + py * bv) / (bx * bx + bv * bv))) AS t
 FROM (SELECT fid, (e - w) * k AS bx, (n - s) * 111320.0 AS bv, (fid % 40) / 10000.0 * k AS px, (fid % 60) / 10000.0 * 111320.0 AS py
  FROM (SELECT *, 111320.0 * cos(radians((s + n + s + (fid % 60) / 10000.0) / 3.0)) AS k FROM {_BOX} a) b) c) d""", VB)
def project_on_segment(spark, d):
    f = c("fid")
    dist, t = P.project_on_segment(c("s") + (f % 60) / 10000.0, c("w") + (f % 40) / 10000.0, c("s"), c("w"), c("n"), c("e"))
    return boxes(spark, d).select("fid", r(t).alias("t"), r(dist, 4).alias("metres"))


_OX, _OY = "(fid % 21 - 10)", "(fid * 7 % 23 - 11)"


@query("axis_of", f"""SELECT fid, CASE WHEN abs({_OX}) <= abs({_OY}) * 0.2 THEN 'ns' WHEN abs({_OY}) <= abs({_OX}) * 0.2 THEN 'ew' ELSE 'diagonal' END AS axis FROM v_building""", VB)
def axis_of(spark, d):
    return view(spark, d, "v_building").select("fid", P.axis_of(F.expr(_OX), F.expr(_OY)).alias("axis"))


@query("face_of", f"""SELECT fid, CASE WHEN abs({_OX}) >= abs({_OY}) THEN CASE WHEN {_OX} > 0 THEN 'E' ELSE 'W' END WHEN {_OY} > 0 THEN 'S' ELSE 'N' END AS face FROM v_building""", VB)
def face_of(spark, d):
    return view(spark, d, "v_building").select("fid", P.face_of(F.expr(_OX), F.expr(_OY)).alias("face"))


@query("turn_angle", """SELECT fid, round(CASE WHEN d > pi() THEN 2 * pi() - d ELSE d END, 9) AS turn
FROM (SELECT fid, abs((fid % 63) / 10.0 - (fid * 5 % 61) / 10.0) AS d FROM v_building) q""", VB)
def turn_angle(spark, d):
    return view(spark, d, "v_building").select("fid", r(P.turn_angle(F.expr("(fid % 63) / 10.0"), F.expr("(fid * 5 % 61) / 10.0")), 9).alias("turn"))


# ------------------------------------------------------------------- arrays
@query("close_ring", f"SELECT fid, CAST(5 AS INT) AS n, ax AS last_x FROM {_QUAD} q", VB)
def close_ring(spark, d):
    ring = P.close_ring(c("pts"))
    return quads(spark, d).select("fid", F.size(ring).alias("n"), F.element_at(ring, -1)["x"].alias("last_x"))


@query("ring_mean", f"SELECT fid, (ax + bx + cx + dx) / 4 AS x, (ay + bv + cy + dy) / 4 AS y FROM {_QUAD} q", VB)
def ring_mean(spark, d):
    return quads(spark, d).select("fid", P.ring_mean(c("pts")).alias("m")).select("fid", "m.x", "m.y")


@query("drop_repeat", "SELECT fid, CAST(3 + (fid % 2) + (CASE WHEN fid % 3 > 0 THEN 1 ELSE 0 END) AS INT) AS n FROM v_building", VB)
def drop_repeat(spark, d):
    x, y, f = c("x0"), c("y0"), c("fid")
    line = F.array(xy(x, y), xy(x + f % 2, y), xy(x + f % 2, y + 5), xy(x + f % 2, y + 5 + f % 3), xy(x + 40, y + 9))
    return view(spark, d, "v_building").select("fid", F.size(P.drop_repeats(line)).alias("n"))


@query("interpolate", """SELECT fid, CASE WHEN dist <= w THEN x0 + dist ELSE CAST(x0 + w AS DOUBLE) END AS x, CASE WHEN dist <= w THEN CAST(y0 AS DOUBLE) ELSE y0 + least(dist - w, h) END AS y
FROM (SELECT *, CAST(fid % 50 AS DOUBLE) / 2 AS dist FROM v_building) q""", VB)
def interpolate(spark, d):
    x, y, w, h = c("x0"), c("y0"), c("w"), c("h")
    line = F.array(xy(x, y), xy(x + w, y), xy(x + w, y + h))
    return view(spark, d, "v_building").select("fid", P.interpolate(line, (c("fid") % 50).cast("double") / 2).alias("p")).select("fid", "p.x", "p.y")


@query("line_substring", "SELECT fid, CAST(w - 1 + h - 1 AS DOUBLE) AS len, CAST(3 AS INT) AS n FROM v_building", VB)
def line_substring(spark, d):
    x, y, w, h = c("x0"), c("y0"), c("w"), c("h")
    line = F.array(xy(x, y), xy(x + w, y), xy(x + w, y + h))
    part = P.line_substring(line, F.lit(1.0), (w + h - 1).cast("double"))
    return view(spark, d, "v_building").select("fid", r(P.line_length(part)).alias("len"), F.size(part).alias("n"))


@query("octilinear_legs", """SELECT fid, CAST(CASE WHEN w >= h THEN x0 + (greatest(w, h) - least(w, h)) // 2 ELSE x0 END AS INT) AS ax,
 CAST(CASE WHEN w >= h THEN y0 ELSE y0 + (greatest(w, h) - least(w, h)) // 2 END AS INT) AS ay,
 CAST(CASE WHEN w >= h THEN x0 + (greatest(w, h) - least(w, h)) // 2 ELSE x0 END + least(w, h) AS INT) AS bx FROM v_building""", VB)
def octilinear_legs(spark, d):
    legs = P.octilinear_legs(c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h"))
    return view(spark, d, "v_building").select("fid", legs.alias("l")).select("fid", c("l")[0]["x"].alias("ax"), c("l")[0]["y"].alias("ay"), c("l")[1]["x"].alias("bx"))


@query("road_strip", "SELECT fid, CAST(2 AS INT) AS quads, CAST((w + h) * 3 AS DOUBLE) AS area FROM v_building", VB)
def road_strip(spark, d):
    x, y, w, h = c("x0"), c("y0"), c("w"), c("h")
    strips = P.road_strip(F.array(xy(x, y), xy(x + w, y), xy(x + w, y + h)), F.lit(1.5))
    area = F.aggregate(strips, F.lit(0.0), lambda acc, q: acc + P.ring_area(q))
    return view(spark, d, "v_building").select("fid", F.size(strips).alias("quads"), r(area).alias("area"))


@query("clean_ring", "SELECT fid, CAST(4 AS INT) AS n, CAST(w * h AS DOUBLE) AS area FROM v_building", VB)
def clean_ring(spark, d):
    x, y, w, h = c("x0"), c("y0"), c("w"), c("h")
    ring = F.array(xy(x + 0.2, y + 0.1), xy(x + 2, y), xy(x + w - 0.3, y + 0.3), xy(x + w, y), xy(x + w, y + h), xy(x, y + h), xy(x, y + 2.2), xy(x, y))
    return view(spark, d, "v_building").select("fid", P.clean_ring(ring).alias("p")).select("fid", F.size("p").alias("n"), P.ring_area(c("p")).alias("area"))


@query("scale_ring", f"SELECT fid, round({_SHOELACE} * 2.25, 4) AS area FROM {_QUAD} q", VB)
def scale_ring(spark, d):
    return quads(spark, d).select("fid", r(P.ring_area(P.scale_ring(c("pts"), F.lit(1.5))), 4).alias("area"))


@query("flatten_rings", "SELECT fid, CAST(CASE WHEN fid % 2 = 0 THEN 1 ELSE 2 END AS INT) AS rings, CAST(x0 + w AS DOUBLE) AS max_x FROM v_building", VB)
def flatten_rings(spark, d):
    ring = F.format_string("[[%d,%d],[%d,%d],[%d,%d],[%d,%d]]", "x0", "y0", c("x0") + c("w"), "y0", c("x0") + c("w"), c("y0") + c("h"), "x0", "y0")
    one = F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))
    two = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit("]]}"))
    rings = P.flatten_rings(F.when(c("fid") % 2 == 0, one).otherwise(two))
    return view(spark, d, "v_building").select("fid", rings.alias("rr")).select("fid", F.size("rr").alias("rings"), P.bounds(c("rr")[0])["x1"].alias("max_x"))


@query("shape_to_tiles")
def shape_to_tiles(spark, d):
    """Rings in degrees to rings in tiles."""
    def to_px(p):
        return U.project_point(p["y"], p["x"], GRID)

    ring = F.array(xy(c("w"), c("s")), xy(c("e"), c("s")), xy(c("e"), c("n")), xy(c("w"), c("n")))
    # Dealt out: the boxes are a small file, one task otherwise.
    return boxes(spark, d).repartition("fid").select("fid", F.transform(ring, to_px).alias("p")).select("fid", r(P.ring_area(c("p")), 2).alias("tiles"))


# ------------------------------------------------------------------- loops over points
def zigzag():
    x, y, w, h, f = c("x0"), c("y0"), c("w"), c("h"), c("fid")
    return F.array(xy(x, y), xy(x + w / 4, y + 1), xy(x + w / 2, y + f % 5), xy(x + w, y), xy(x + w, y + h / 3), xy(x + w + f % 2, y + h))


@query("simplify_line")
def simplify_line(spark, d):
    return view(spark, d, "v_building").select("fid", H.simplify_line(zigzag(), 1.5).alias("p")).select("fid", F.size("p").alias("n"))


@query("simplify_to_budget")
def simplify_to_budget(spark, d):
    return view(spark, d, "v_building").select("fid", H.simplify_to_budget(zigzag(), 4, tries=30).alias("p")).select("fid", F.size("p").alias("n"))


@query("min_rotated_rect", "SELECT fid, CAST(least(w, h) AS DOUBLE) AS short_side, CAST(greatest(w, h) AS DOUBLE) AS long_side FROM v_building", VB)
def min_rotated_rect(spark, d):
    x, y, w, h = c("x0"), c("y0"), c("w"), c("h")
    ring = F.array(xy(x, y), xy(x + w, y), xy(x + w, y + h), xy(x + w / 2, y + h), xy(x, y + h))
    return view(spark, d, "v_building").select("fid", H.min_rotated_rect(ring).alias("m")).select("fid", r(c("m.short_side")).alias("short_side"), r(c("m.long_side")).alias("long_side"))


@query("grid_angle", "SELECT fid, round(least(a, 90 - a), 6) AS angle FROM (SELECT fid, CAST(fid % 90 AS DOUBLE) AS a FROM v_building) q", VB)
def grid_angle(spark, d):
    a = F.radians(c("fid") % 90)
    def turned(u, v):
        return xy(u * F.cos(a) - v * F.sin(a), u * F.sin(a) + v * F.cos(a))

    ring = F.array(turned(F.lit(0.0), F.lit(0.0)), turned(c("w") + 30.0, F.lit(0.0)), turned(c("w") + 30.0, c("h") * 1.0), turned(F.lit(0.0), c("h") * 1.0))
    return view(spark, d, "v_building").select("fid", H.min_rotated_rect(ring).alias("m")).select("fid", r(c("m.angle")).alias("angle"))


@query("grid_path", "SELECT fid, CAST(w + h + 1 AS INT) AS corners FROM v_building", VB)
def grid_path(spark, d):
    x, y = c("x0"), c("y0")
    line = F.array(xy(x, y), xy(x + c("w"), y + c("h")))
    return view(spark, d, "v_building").select("fid", F.size(H.grid_path(line)).alias("corners"))
