"""Joins of points and lines with polygons of any shape, through covers of grid cells.

A polygon is a set of edges: rows of a key and ax, ay, bx, by, a row for each side of
each of its rings, in any order. What an even number of its edges separates from the
outside is outside, so holes are rings like others.

The cover of a polygon has a row for each edge in each cell that the edge passes, and a
flag for each cell whose reference place lies inside. A point joins the rows of its own
cell only: it is inside if the flag and the edges between the point and the reference
place together are odd in number. So a point never meets edges of the polygon that lie
elsewhere, and deep inside a polygon it meets the flag alone. The larger a polygon and
the fewer its edges, the larger its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as P

LEVELS = (8.0, 64.0, 512.0)  # sides of cells
# The reference place, as a share of the cell: off every place that coordinates are likely to have.
REF_X, REF_Y = 0.501730291, 0.498312047
SLACK = 1e-6  # an edge also counts in cells it misses by this
EDGE = ["ax", "ay", "bx", "by"]


def c(name: str) -> Column:
    return F.col(name)


def box_edges(boxes: DataFrame, keep: list[str], x0="x0", y0="y0", w="w", h="h") -> DataFrame:
    """The four edges of each rectangle, with the kept columns."""
    x, y, x1, y1 = c(x0), c(y0), c(x0) + c(w), c(y0) + c(h)
    corners = [(x, y), (x1, y), (x1, y1), (x, y1)]
    sides = F.array(*[F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for a, b in zip(corners, corners[1:] + corners[:1])])
    return boxes.select(*keep, F.explode(sides).alias("_e")).select(*keep, "_e.*")


def polygon_area(edges: DataFrame, key: list[str], ring: str = "ring") -> DataFrame:
    """(key, area): the outer ring, numbered 0, less its holes; orientation does not matter."""
    cross = (c("ax") * c("by") - c("bx") * c("ay")).cast("double")
    rings = edges.groupBy(*key, ring).agg((F.abs(F.sum(cross)) / 2.0).alias("_area"))
    return rings.groupBy(*key).agg(F.sum(F.when(c(ring) == 0, c("_area")).otherwise(-c("_area"))).alias("area"))


def _span(low: Column, high: Column) -> Column:
    """Whole numbers from low to high; none if low is greater."""
    low, high = low.cast("bigint"), high.cast("bigint")
    return F.when(low <= high, F.sequence(low, high))


def _sizes(levels: tuple[float, ...]) -> Column:
    return F.get(F.array(*[F.lit(float(s)) for s in levels]), c("_lvl"))


def leveled(edges: DataFrame, key: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Edges as doubles with the level and cell side of their polygon: about as many cells as it has edges."""
    shape = edges.groupBy(key).agg(
        F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))).alias("_e"),
        F.sqrt(F.count(F.lit(1))).alias("_n"),
    )
    want = c("_e") / F.greatest(F.lit(2.0), c("_n"))
    level = F.lit(len(levels) - 1)
    for i in range(len(levels) - 2, -1, -1):
        level = F.when(want <= F.lit((levels[i] * levels[i + 1]) ** 0.5), F.lit(i)).otherwise(level)
    sized = shape.select(key, level.alias("_lvl"))
    return edges.select(key, *[c(e).cast("double").alias(e) for e in EDGE]).join(sized, key).withColumn("_s", _sizes(levels))


def edge_cells(df: DataFrame, reach: float = 0.0) -> DataFrame:
    """A row for each cell that a segment comes within `reach` of; `_s` is the side of its cells."""
    pad = F.lit(reach + SLACK)
    s = c("_s")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = df.withColumn("_cy", F.explode(_span(F.floor((low - pad) / s), F.floor((high + pad) / s))))
    # The part of the segment within this row of cells, and how far it reaches to both sides.
    from_y = F.greatest(low, F.least(high, c("_cy") * s - pad))
    to_y = F.least(high, F.greatest(low, (c("_cy") + 1) * s + pad))
    flat = c("ay") == c("by")
    at = lambda y: c("ax") + (y - c("ay")) * (c("bx") - c("ax")) / F.nullif(c("by") - c("ay"), F.lit(0.0))
    x1 = F.when(flat, c("ax")).otherwise(at(from_y))
    x2 = F.when(flat, c("bx")).otherwise(at(to_y))
    ends = rows.withColumns({"_x1": F.least(x1, x2), "_x2": F.greatest(x1, x2)})
    return ends.withColumn("_cx", F.explode(_span(F.floor((c("_x1") - pad) / s), F.floor((c("_x2") + pad) / s)))).drop("_x1", "_x2")


def scan_spans(edges: DataFrame, key: list[str], line_y: Column) -> DataFrame:
    """(key, x1, x2): the stretches of each polygon along a line y = line_y of each row of edges.

    `key` names a polygon and a line. Crossings are paired in order, first with second.
    """
    hits = edges.withColumn("_y", line_y).where((c("ay") > c("_y")) != (c("by") > c("_y"))) \
        .withColumn("_x", c("ax") + (c("_y") - c("ay")) * (c("bx") - c("ax")) / (c("by") - c("ay")))
    along = Window.partitionBy(*key).orderBy("_x")
    return hits.select(*key, c("_x").alias("x1"), F.lead("_x").over(along).alias("x2"), F.row_number().over(along).alias("_i")) \
        .where("_i % 2 = 1 AND x2 IS NOT NULL").drop("_i")


def cover(edges: DataFrame, key: str, reach: float = 0.0, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(key, _lvl, _cx, _cy, ax, ay, bx, by): flags, without an edge, and edges of cells."""
    sized = leveled(edges, key, levels)
    passed = edge_cells(sized, reach).select(key, "_lvl", "_cx", "_cy", *EDGE)
    s = c("_s")
    low, high = F.least("ay", "by"), F.greatest("ay", "by")
    rows = sized.withColumn("_cy", F.explode(_span(F.ceil(low / s - REF_Y), F.floor(high / s - REF_Y))))
    spans = scan_spans(rows, [key, "_lvl", "_s", "_cy"], (c("_cy") + REF_Y) * s)
    flags = spans.withColumn("_cx", F.explode(_span(F.ceil(c("x1") / s - REF_X), F.floor(c("x2") / s - REF_X))))
    return passed.unionByName(flags.select(key, "_lvl", "_cx", "_cy", *[F.lit(None).cast("double").alias(e) for e in EDGE]))


def _side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _in_cells(df: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Points with the cell they lie in on every level."""
    probe = df.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1)))).withColumn("_s", _sizes(levels))
    return probe.withColumns({"_cx": F.floor(c("_px") / c("_s")), "_cy": F.floor(c("_py") / c("_s"))})


def ring_hits(
    points: DataFrame, edges: DataFrame, pid: str, key: str, x: str = "x", y: str = "y", reach: float | None = None, levels: tuple[float, ...] = LEVELS,
) -> DataFrame:
    """(pid, key, inside, distance) of each point and polygon that it lies inside or near.

    `inside` excludes the edges themselves. `distance` is that to the nearest edge of the
    polygon in or about the point's cell; it is right up to `reach`, and null where no
    edge is so near. Without a reach only pairs that lie inside are returned. `pid`
    must be unique. All rows of a pair meet in one cell, so they are added up where they
    are joined; a crowded cell can be split by its points.
    """
    probe = _in_cells(points.select(pid, c(x).cast("double").alias("_px"), c(y).cast("double").alias("_py")), levels)
    met = probe.join(cover(edges, key, reach or 0.0, levels), ["_lvl", "_cx", "_cy"])
    px, py, rx, ry = c("_px"), c("_py"), (c("_cx") + REF_X) * c("_s"), (c("_cy") + REF_Y) * c("_s")
    end = [c(e) for e in EDGE]
    flag = c("ax").isNull()
    turn = _side(*end, px, py)
    parts = ((_side(*end, rx, ry) > 0) != (turn > 0)) & ((_side(rx, ry, px, py, *end[:2]) > 0) != (_side(rx, ry, px, py, *end[2:]) > 0))
    on = (turn == 0) & px.between(F.least("ax", "bx"), F.greatest("ax", "bx")) & py.between(F.least("ay", "by"), F.greatest("ay", "by"))
    sums = [F.sum(F.when(flag, 1).otherwise(parts.cast("int"))).alias("_n"), F.max(F.when(~flag, on.cast("int")).otherwise(0)).alias("_on")]
    if reach is not None:
        sums.append(F.min(F.when(~flag, P.segment_distance(px, py, *end))).alias("distance"))
    inside = (c("_n") % 2 == 1) & (c("_on") == 0)
    pairs = met.groupBy(pid, key).agg(*sums)
    if reach is None:
        return pairs.where(inside).select(pid, key, F.lit(True).alias("inside"), F.lit(None).cast("double").alias("distance"))
    return pairs.withColumn("inside", inside).where(c("inside") | (c("distance") <= reach)).select(pid, key, "inside", "distance")


def interior_points(edges: DataFrame, key: str) -> DataFrame:
    """(key, x, y): a place inside each polygon, in the middle of its widest stretch along one line.

    The line runs half-way between the vertices next above and next below the middle of
    the polygon's height, so it meets no vertex. Of equal stretches the leftmost is taken.
    A polygon without height has none.
    """
    e = edges.select(key, *[c(n).cast("double").alias(n) for n in EDGE])
    middle = e.groupBy(key).agg(((F.min("ay") + F.max("ay")) / 2.0).alias("_mid"))
    lines = e.join(middle, key).groupBy(key).agg(
        ((F.max(F.when(c("ay") <= c("_mid"), c("ay"))) + F.min(F.when(c("ay") > c("_mid"), c("ay")))) / 2.0).alias("_line")
    )
    spans = scan_spans(e.join(lines, key), [key, "_line"], c("_line"))
    widest = spans.groupBy(key, "_line").agg(F.max_by(F.struct("x1", "x2"), F.struct((c("x2") - c("x1")).alias("w"), (-c("x1")).alias("o"))).alias("_b"))
    return widest.select(key, ((c("_b.x1") + c("_b.x2")) / 2.0).alias("x"), c("_line").alias("y"))


def lines_meeting(lines: DataFrame, edges: DataFrame, lid: str, key: str, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(lid, key) of lines that share a place with a polygon: they touch an edge, or lie inside.

    `lines` has a row for each segment: lid, pos, px, py, qx, qy. A segment meets the edges
    of the cells that both pass. A line that touches no edge is inside where its first
    point is.
    """
    segments = lines.select(lid, *[c(n).cast("double").alias(n) for n in ("px", "py", "qx", "qy")])
    ends = {"px": "ax", "py": "ay", "qx": "bx", "qy": "by"}
    probe = segments.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1)))).withColumn("_s", _sizes(levels))
    probe = edge_cells(probe.withColumnsRenamed(ends)).withColumnsRenamed({v: k for k, v in ends.items()})
    walls = edge_cells(leveled(edges, key, levels)).select(key, "_lvl", "_cx", "_cy", *EDGE)
    met = probe.join(walls, ["_lvl", "_cx", "_cy"])
    p, q, a, b = (c("px"), c("py")), (c("qx"), c("qy")), (c("ax"), c("ay")), (c("bx"), c("by"))
    d1, d2, d3, d4 = _side(*a, *b, *p), _side(*a, *b, *q), _side(*p, *q, *a), _side(*p, *q, *b)
    overlap = (F.least("px", "qx") <= F.greatest("ax", "bx")) & (F.least("ax", "bx") <= F.greatest("px", "qx")) \
        & (F.least("py", "qy") <= F.greatest("ay", "by")) & (F.least("ay", "by") <= F.greatest("py", "qy"))
    crossing = overlap & (F.signum(d1) * F.signum(d2) <= 0) & (F.signum(d3) * F.signum(d4) <= 0)
    touched = met.where(crossing).select(lid, key)
    first = lines.groupBy(lid).agg(F.min_by(F.struct(c("px").alias("x"), c("py").alias("y")), "pos").alias("_start")).select(lid, "_start.x", "_start.y")
    within = ring_hits(first, edges, lid, key, levels=levels).select(lid, key)
    return touched.unionByName(within).distinct()


# ------------------------------------------------------------------- joins by what the pairs are for
def claimed_points(points: DataFrame, edges: DataFrame, reach: float = 1.0, ring: str = "ring") -> DataFrame:
    """(pid, fid): the footprint that claims each point inside it or less than `reach` outside.

    Larger footprints claim first, then those with smaller ids. Points of one place are
    one: the first of them is claimed, the others never.
    """
    places = points.groupBy("x", "y").agg(F.min("pid").alias("pid"))
    hits = ring_hits(places, edges, "pid", "fid", reach=reach).where(c("inside") | (c("distance") < reach))
    turn = polygon_area(edges, ["fid"], ring).select("fid", F.struct((-c("area")).alias("a"), c("fid").alias("i")).alias("_turn"))
    return hits.join(turn, "fid").groupBy("pid").agg(F.min_by("fid", "_turn").alias("fid"))


def smallest_around(points: DataFrame, edges: DataFrame, areas: DataFrame, keep: list[str], pid: str, x: str = "px", y: str = "py", ring: str = "ring") -> DataFrame:
    """Points with the columns of the smallest area strictly around them, and `covered`; ties go to the smaller aid.

    Points of one place are looked up once.
    """
    places = points.select(c(x).alias("_x"), c(y).alias("_y")).distinct().withColumn("_place", F.struct("_x", "_y"))
    turn = polygon_area(edges, ["aid"], ring).join(areas.select("aid", *keep), "aid") \
        .select("aid", F.struct(c("area"), c("aid").alias("i")).alias("_turn"), F.struct(*keep).alias("_keep"))
    hits = ring_hits(places, edges, "_place", "aid", "_x", "_y").join(turn, "aid")
    best = hits.groupBy("_place").agg(F.min_by("_keep", "_turn").alias("_k"))
    found = points.withColumn("_place", F.struct(c(x).alias("_x"), c(y).alias("_y"))).join(best, "_place", "left")
    return found.select(points["*"], *[c(f"_k.{k}").alias(k) for k in keep], c("_k").isNotNull().alias("covered"))


def seeds_around(points: DataFrame, edges: DataFrame, regions: DataFrame, pid: str, x: str = "px", y: str = "py") -> DataFrame:
    """(pid, nudge): the sum of the seeds of all regions strictly around each point; one without a seed counts 1."""
    hits = ring_hits(points, edges, pid, "aid", x, y).join(regions.select("aid", F.coalesce("seed", F.lit(1)).alias("_seed")), "aid")
    total = hits.groupBy(pid).agg(F.sum("_seed").alias("nudge"))
    return points.select(pid).join(total, pid, "left").select(pid, F.coalesce("nudge", F.lit(0)).alias("nudge"))


def outside_all(points: DataFrame, edges: DataFrame, pid: str = "pid", key: str = "fid", x: str = "x", y: str = "y", distance: float | None = None) -> DataFrame:
    """Points inside no polygon and, with a distance, more than that from every one."""
    hits = ring_hits(points, edges, pid, key, x, y, reach=distance).select(pid).distinct()
    return points.join(hits, pid, "left_anti")


def in_any_shape(places: DataFrame, lines: DataFrame, shapes: DataFrame, key: str = "sid") -> DataFrame:
    """(kind, id) of the features that belong to drawn shapes.

    `places` has kind, id, x, y: points, and interior points of areas, which belong where
    they lie. `lines` has kind, id, pos, px, py, qx, qy: lines belong where they meet a shape.
    """
    of = F.struct("kind", "id")
    spots = ring_hits(places.withColumn("_f", of), shapes, "_f", key).select("_f")
    met = lines_meeting(lines.withColumn("_f", of), shapes, "_f", key).select("_f")
    return spots.unionByName(met).distinct().select("_f.kind", "_f.id")
