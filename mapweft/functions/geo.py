"""Geometry as column expressions over points, boxes and point arrays.

Point arrays hold structs with fields x and y (or lon and lat renamed to them).
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as V


# ------------------------------------------------------------------- distances
def metres_between(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dy = (lat2 - lat1) * V.METRES_PER_DEGREE
    dx = (lon2 - lon1) * V.METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2.0))
    return F.sqrt(dx * dx + dy * dy)


def point_line_distance(px, py, ax, ay, bx, by) -> Column:
    """Distance to the infinite line through a and b, or to a when they coincide."""
    dx, dy = bx - ax, by - ay
    length = F.sqrt(dx * dx + dy * dy)
    apart = F.sqrt((px - ax) * (px - ax) + (py - ay) * (py - ay))
    return F.when(length == 0, apart).otherwise(F.abs(dx * (ay - py) - (ax - px) * dy) / length)


def segment_parameter(px, py, ax, ay, bx, by) -> Column:
    """Fraction along ab of the nearest point, clamped to the segment."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0))
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    t = segment_parameter(px, py, ax, ay, bx, by)
    qx, qy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(qx * qx + qy * qy)


def project_on_segment(lat, lon, lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """(metres to the segment, fraction along it) in local equirectangular metres."""
    k = V.METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2 + lat) / 3.0))
    bx, by = (lon2 - lon1) * k, (lat2 - lat1) * V.METRES_PER_DEGREE
    px, py = (lon - lon1) * k, (lat - lat1) * V.METRES_PER_DEGREE
    len2 = bx * bx + by * by
    t = F.when(len2 <= 1e-6, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * bx + py * by) / F.nullif(len2, F.lit(0.0)))))
    dx, dy = px - bx * t, py - by * t
    return F.sqrt(dx * dx + dy * dy), t


# ------------------------------------------------------------------- boxes
def boxes_meet(s1, w1, n1, e1, s2, w2, n2, e2) -> Column:
    return ~((n1 < s2) | (s1 > n2) | (e1 < w2) | (w1 > e2))


def box_contains(s1, w1, n1, e1, s2, w2, n2, e2) -> Column:
    return (s1 <= s2) & (w1 <= w2) & (n1 >= n2) & (e1 >= e2)


def box_has_point(s, w, n, e, lat, lon) -> Column:
    return lat.between(s, n) & lon.between(w, e)


def area_km2(s, w, n, e) -> Column:
    mid = F.cos(F.radians((s + n) / 2.0))
    return (n - s) * (V.METRES_PER_DEGREE / 1000.0) * (e - w) * (V.METRES_PER_DEGREE / 1000.0) * mid


def segment_hits_box(lat1, lon1, lat2, lon2, s, w, n, e) -> Column:
    """Whether a segment meets a box, edges included.

    Slab test: the segment's parameter range inside the latitude band and
    inside the longitude band must overlap within 0..1.
    """
    def band(a, b, lo, hi):
        d = b - a
        t1, t2 = (lo - a) / F.nullif(d, F.lit(0.0)), (hi - a) / F.nullif(d, F.lit(0.0))
        flat_in = a.between(lo, hi)
        enter = F.when(d == 0, F.when(flat_in, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(t1, t2))
        leave = F.when(d == 0, F.when(flat_in, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(t1, t2))
        return enter, leave

    in1 = box_has_point(s, w, n, e, lat1, lon1)
    in2 = box_has_point(s, w, n, e, lat2, lon2)
    lat_in, lat_out = band(lat1, lat2, s, n)
    lon_in, lon_out = band(lon1, lon2, w, e)
    crosses = F.greatest(lat_in, lon_in, F.lit(0.0)) <= F.least(lat_out, lon_out, F.lit(1.0))
    return in1 | in2 | crosses


def wrap_lon(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def normalise_bbox(s, w, n, e) -> Column:
    """The box folded into range, with the reason it cannot be used, if any."""
    s2 = F.greatest(F.lit(-85.05), F.least(F.lit(85.05), s))
    n2 = F.greatest(F.lit(-85.05), F.least(F.lit(85.05), n))
    w2, e2 = wrap_lon(w), wrap_lon(e)
    problem = F.when(~(s2 < n2) | (w2 == e2), F.lit("degenerate")).when(w2 > e2, F.lit("antimeridian"))
    return F.struct(s2.alias("s"), w2.alias("w"), n2.alias("n"), e2.alias("e"), problem.alias("problem"))


def bbox_for_cells(s, w, n, e, metres_per_tile: float) -> Column:
    """The box grown by one cell each way."""
    dlat = metres_per_tile * V.CELL / V.METRES_PER_DEGREE
    dlon = F.lit(dlat) / F.greatest(F.lit(0.2), F.cos(F.radians((s + n) / 2.0)))
    return F.struct(F.greatest(F.lit(-90.0), s - dlat).alias("s"), F.greatest(F.lit(-180.0), w - dlon).alias("w"),
                    F.least(F.lit(90.0), n + dlat).alias("n"), F.least(F.lit(180.0), e + dlon).alias("e"))


# ------------------------------------------------------------------- point arrays
def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times inside `body`."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bound(fn):
    """Bind the first argument, so that lambdas inside `fn` do not evaluate it once per element."""
    @functools.wraps(fn)
    def call(pts: Column, *args, **kwargs) -> Column:
        return let(pts, lambda p: fn(p, *args, **kwargs))

    return call


@bound
def edges(pts: Column) -> Column:
    """Edges of a ring as structs (a, b); the last point joins the first."""
    n = F.size(pts)
    return F.transform(pts, lambda p, i: F.struct(p.alias("a"), F.get(pts, (i + 1) % n).alias("b")))


@bound
def segments(pts: Column) -> Column:
    """Consecutive point pairs of an open line."""
    n = F.size(pts)
    return F.when(n >= 2, F.transform(F.slice(pts, 1, F.greatest(n - 1, F.lit(0))),
                                      lambda p, i: F.struct(p.alias("a"), F.get(pts, i + 1).alias("b"))))


def point_in_ring(pts: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast; half-open in y, so shared edges belong to one side."""
    def crosses(ed):
        a, b = ed["a"], ed["b"]
        reach = (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return ((a["y"] > y) != (b["y"] > y)) & F.coalesce(x < reach, F.lit(False))

    return (F.size(pts) >= 3) & (F.size(F.filter(edges(pts), crosses)) % 2 == 1)


@bound
def ring_area(pts: Column) -> Column:
    """Shoelace area about the first point, orientation ignored."""
    o = F.get(pts, F.lit(0))

    def step(acc, ed):
        a, b = ed["a"], ed["b"]
        return acc + (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])

    return F.abs(F.aggregate(edges(pts), F.lit(0.0), step)) / 2.0


def area_m2(pts: Column) -> Column:
    """Ring area in square metres, points in degrees (x = lon, y = lat)."""
    n = F.size(pts)
    mid = F.aggregate(pts, F.lit(0.0), lambda acc, p: acc + p["y"]) / n
    return ring_area(pts) * V.METRES_PER_DEGREE * V.METRES_PER_DEGREE * F.cos(F.radians(mid))


def shape_area_deg2(polys: Column) -> Column:
    """Sum over polygons of their first ring's area in square degrees."""
    return F.aggregate(polys, F.lit(0.0), lambda acc, rings: acc + F.coalesce(ring_area(F.get(rings, F.lit(0))), F.lit(0.0)))


def line_length(pts: Column) -> Column:
    def step(acc, sg):
        dx, dy = sg["b"]["x"] - sg["a"]["x"], sg["b"]["y"] - sg["a"]["y"]
        return acc + F.sqrt(dx * dx + dy * dy)

    return F.coalesce(F.aggregate(segments(pts), F.lit(0.0), step), F.lit(0.0))


def bounds(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


@bound
def close_ring(pts: Column) -> Column:
    first, last = F.get(pts, F.lit(0)), F.get(pts, F.size(pts) - 1)
    return F.when((F.size(pts) > 0) & (first != last), F.concat(pts, F.array(first))).otherwise(pts)


@bound
def open_ring(pts: Column) -> Column:
    first, last = F.get(pts, F.lit(0)), F.get(pts, F.size(pts) - 1)
    return F.when((F.size(pts) > 1) & (first == last), F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0)))).otherwise(pts)


@bound
def ring_mean(pts: Column) -> Column:
    n = F.size(pts)
    return F.struct((F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["x"]) / n).alias("x"),
                    (F.aggregate(pts, F.lit(0.0), lambda a, p: a + p["y"]) / n).alias("y"))


@bound
def drop_repeats(pts: Column) -> Column:
    """Remove points equal to the one before."""
    return F.filter(pts, lambda p, i: (i == 0) | (p != F.get(pts, i - 1)))


@bound
def drop_collinear(pts: Column) -> Column:
    """Remove points in the middle of a straight run (open line)."""
    n = F.size(pts)

    def bends(p, i):
        a, b = F.get(pts, i - 1), F.get(pts, i + 1)
        turn = (p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])
        ahead = (p["x"] - a["x"]) * (b["x"] - p["x"]) + (p["y"] - a["y"]) * (b["y"] - p["y"])
        return (i == 0) | (i == n - 1) | (turn != 0) | (ahead < 0)

    return F.filter(pts, bends)


def clean_ring(pts: Column, min_points: int = 3) -> Column:
    """Whole-tile ring without repeats or straight-run points; null when too little is left."""
    whole = F.transform(pts, lambda p: F.struct(F.rint(p["x"]).cast("int").alias("x"), F.rint(p["y"]).cast("int").alias("y")))
    kept = _corners(open_ring(drop_repeats(whole)))
    return let(kept, lambda k: F.when(F.size(k) >= min_points, k))


@bound
def _corners(ring: Column) -> Column:
    n = F.size(ring)

    def bends(p, i):
        a, b = F.get(ring, (i + n - 1) % n), F.get(ring, (i + 1) % n)
        return ((p["x"] - a["x"]) * (b["y"] - p["y"]) - (p["y"] - a["y"]) * (b["x"] - p["x"])) != 0

    return F.filter(ring, bends)


@bound
def scale_ring(pts: Column, factor: Column) -> Column:
    """Scale about the mean of the points."""
    c = ring_mean(pts)
    return F.transform(pts, lambda p: F.struct((c["x"] + (p["x"] - c["x"]) * factor).alias("x"),
                                               (c["y"] + (p["y"] - c["y"]) * factor).alias("y")))


def octilinear_legs(ax, ay, bx, by) -> Column:
    """Grid, diagonal, grid: the corner points from a to b."""
    dx, dy = bx - ax, by - ay
    sx, sy = F.signum(dx).cast("int"), F.signum(dy).cast("int")
    diag = F.least(F.abs(dx), F.abs(dy))
    first = F.floor((F.greatest(F.abs(dx), F.abs(dy)) - diag) / 2).cast("int")
    along_x = F.abs(dx) >= F.abs(dy)
    p1x = F.when(along_x, ax + sx * first).otherwise(ax)
    p1y = F.when(along_x, ay).otherwise(ay + sy * first)

    def pt(x, y):
        return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))

    return F.array(pt(p1x, p1y), pt(p1x + sx * diag, p1y + sy * diag), pt(bx, by))


@bound
def cumulative(pts: Column) -> Column:
    """Distance from the start at every point of a line."""
    n = F.size(pts)
    start = F.struct(F.array(F.lit(0.0)).alias("out"), F.lit(0.0).alias("sum"))

    def step(acc, sg):
        dx, dy = sg["b"]["x"] - sg["a"]["x"], sg["b"]["y"] - sg["a"]["y"]
        total = acc["sum"] + F.sqrt(dx * dx + dy * dy)
        return F.struct(F.concat(acc["out"], F.array(total)).alias("out"), total.alias("sum"))

    return F.when(n >= 2, F.aggregate(segments(pts), start, step)["out"]).otherwise(F.array(F.lit(0.0)))


def _with_distance(pts: Column) -> Column:
    """The points with their distance from the start, as (p, d)."""
    return let(cumulative(pts), lambda cum: F.transform(pts, lambda p, i: F.struct(p.alias("p"), F.get(cum, i).alias("d"))))


def _at(marks: Column, at: Column) -> Column:
    """The point at a distance along marked points."""
    n = F.size(marks)
    d = F.greatest(F.lit(0.0), F.least(at, F.get(marks, n - 1)["d"]))
    i = F.greatest(F.lit(0), F.least(F.size(F.filter(marks, lambda m: m["d"] <= d)) - 1, n - 2))

    def between(i):
        a, b = F.get(marks, i), F.get(marks, i + 1)
        t = F.coalesce((d - a["d"]) / F.nullif(b["d"] - a["d"], F.lit(0.0)), F.lit(0.0))
        return F.struct((a["p"]["x"] + (b["p"]["x"] - a["p"]["x"]) * t).alias("x"),
                        (a["p"]["y"] + (b["p"]["y"] - a["p"]["y"]) * t).alias("y"))

    return let(i, between)


@bound
def interpolate(pts: Column, at: Column) -> Column:
    """The point a given distance along a line, clamped to its ends."""
    return let(_with_distance(pts), lambda marks: _at(marks, at))


@bound
def line_substring(pts: Column, start: Column, stop: Column) -> Column:
    """The part of a line between two distances."""
    def part(marks):
        inner = F.filter(marks, lambda m: (m["d"] > start) & (m["d"] < stop))
        return F.concat(F.array(_at(marks, start)),
                        F.transform(inner, lambda m: F.struct(m["p"]["x"].alias("x"), m["p"]["y"].alias("y"))),
                        F.array(_at(marks, stop)))

    return let(_with_distance(pts), part)


def road_strip(pts: Column, half: Column) -> Column:
    """One flat-capped quad per segment, half a width to each side."""
    def quad(sg):
        a, b = sg["a"], sg["b"]
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        length = F.sqrt(dx * dx + dy * dy)
        ux, uy = -dy / F.nullif(length, F.lit(0.0)) * half, dx / F.nullif(length, F.lit(0.0)) * half

        def pt(x, y):
            return F.struct(x.alias("x"), y.alias("y"))

        return F.array(pt(a["x"] + ux, a["y"] + uy), pt(b["x"] + ux, b["y"] + uy),
                       pt(b["x"] - ux, b["y"] - uy), pt(a["x"] - ux, a["y"] - uy))

    moving = F.filter(segments(pts), lambda sg: (sg["a"]["x"] != sg["b"]["x"]) | (sg["a"]["y"] != sg["b"]["y"]))
    return F.transform(moving, quad)


def axis_of(ox: Column, oy: Column) -> Column:
    """ns or ew when within the slope of an axis, else diagonal."""
    ax, ay = F.abs(ox), F.abs(oy)
    return F.when(ax <= ay * V.AXIS_SLOPE, F.lit("ns")).when(ay <= ax * V.AXIS_SLOPE, F.lit("ew")).otherwise(F.lit("diagonal"))


def face_of(ox: Column, oy: Column) -> Column:
    """Compass side an outward arm points at; y grows south."""
    return F.when(F.abs(ox) >= F.abs(oy), F.when(ox > 0, F.lit("E")).otherwise(F.lit("W"))) \
        .otherwise(F.when(oy > 0, F.lit("S")).otherwise(F.lit("N")))


def turn_angle(h1: Column, h2: Column) -> Column:
    """Absolute difference of two headings, wrapped to 0..pi."""
    return F.abs(F.pmod(h2 - h1 + math.pi, F.lit(2 * math.pi)) - math.pi)


# ------------------------------------------------------------------- grid arithmetic
def cell_of(x: Column, size: int = V.CELL) -> Column:
    return F.floor(x / size).cast("int")


def offset_in_cell(x: Column, size: int = V.CELL) -> Column:
    return F.pmod(x, F.lit(size))


def ceil_to(x: Column, step: int) -> Column:
    return (F.ceil(x / step) * step).cast("bigint")


def fixed_point(deg: Column) -> Column:
    """Coordinate in 1e-7 degrees: an exact key for vertex equality."""
    return F.rint(deg * 1e7).cast("bigint")


def flatten_rings(geojson: Column) -> Column:
    """Outer rings of a GeoJSON Polygon or MultiPolygon as arrays of (x, y)."""
    kind = F.get_json_object(geojson, "$.type")
    coords = F.get_json_object(geojson, "$.coordinates")
    poly = F.from_json(coords, "array<array<array<double>>>")
    multi = F.from_json(coords, "array<array<array<array<double>>>>")

    def ring(r):
        return F.transform(r, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))

    one = F.when(F.size(poly) > 0, F.array(ring(F.get(poly, F.lit(0)))))
    many = F.transform(multi, lambda p: ring(F.get(p, F.lit(0))))
    rings = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return F.filter(rings, lambda r: F.size(r) >= 3)
