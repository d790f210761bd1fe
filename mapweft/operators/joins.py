"""Spatial and keyed joins between points, areas, buildings and roads.

Boxes are columns x0, y0, w, h in tiles, half-open; points are x, y.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as P
from ..session import cut, small
from . import painter
from .bucket import boxes_overlap, bucket_join, explode_cells, point


def c(name: str) -> Column:
    return F.col(name)


def box(x0="x0", y0="y0", w="w", h="h"):
    return (c(x0), c(y0), c(x0) + c(w), c(y0) + c(h))


# ------------------------------------------------------------------- identity joins
def way_node_locations(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, pos, node) with coordinates; a way missing any node is dropped whole."""
    located = refs.join(nodes, refs["node"] == nodes["id"], "left")
    broken = located.where(c("id").isNull()).select("way_id").distinct()
    return located.join(broken, "way_id", "left_anti").drop("id")


def relation_members(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(rel_id, way_id) of relations all of whose member ways are present."""
    joined = members.join(ways.select("way_id").withColumn("_ok", F.lit(1)), "way_id", "left")
    whole = joined.groupBy("rel_id").agg(F.count("*").alias("n_members"), F.count("_ok").alias("_n")) \
        .where("n_members = _n").drop("_n")
    return members.join(whole, "rel_id")


def overlay_join(features: DataFrame, overrides: DataFrame, key: str, fields: list[str], deleted: str = "deleted") -> DataFrame:
    """Apply per-id overrides: deleted features go, set fields replace, the rest stay."""
    patch = overrides.select(c(key), c(deleted).alias("_del"), *[c(f).alias(f"_{f}") for f in fields])
    out = features.join(patch, key, "left").where(~F.coalesce("_del", F.lit(False)))
    for f in fields:
        out = out.withColumn(f, F.coalesce(f"_{f}", f)).drop(f"_{f}")
    return out.drop("_del")


# ------------------------------------------------------------------- containment
def points_in_footprint(points: DataFrame, footprints: DataFrame, reach: float = 1.0, cell: float = 32) -> DataFrame:
    """(pid, fid): each point goes to the first footprint, by size, that it falls in."""
    fp = footprints.select("fid", *[b.alias(n) for b, n in zip(box(), ("bx0", "by0", "bx1", "by1"))],
                           F.struct((-c("w") * c("h")).alias("a"), c("fid").alias("i")).alias("turn"))
    inside = (c("x") > c("bx0") - reach) & (c("x") < c("bx1") + reach) & (c("y") > c("by0") - reach) & (c("y") < c("by1") + reach)
    hits = bucket_join(points.select("pid", "x", "y"), fp, point(c("x"), c("y")), ("bx0", "by0", "bx1", "by1"), cell, inside, reach=reach)
    return hits.groupBy("pid").agg(F.min_by("fid", "turn").alias("fid"))


def smallest_area(points: DataFrame, areas: DataFrame, keep: list[str], key: str, cell: float = 64) -> DataFrame:
    """Points with the columns of the smallest area strictly around them; ties go to the earlier area.

    `areas` has aid, x0, y0, side and the kept columns. Equal squares collapse
    to the earliest before the join, so copies of one outline cost one row.
    """
    same = areas.groupBy("x0", "y0", "side").agg(F.min(F.struct("aid", *keep)).alias("_a")) \
        .select(c("x0").alias("_x0"), c("y0").alias("_y0"), (c("x0") + c("side")).alias("_x1"), (c("y0") + c("side")).alias("_y1"),
                F.struct((c("side") * c("side")).alias("tiles"), c("_a.aid").alias("aid")).alias("_turn"),
                F.struct(*[c(f"_a.{k}").alias(k) for k in keep]).alias("_keep"))
    inside = (c("px") > c("_x0")) & (c("px") < c("_x1")) & (c("py") > c("_y0")) & (c("py") < c("_y1"))
    hits = bucket_join(points.select(key, "px", "py"), same, point(c("px"), c("py")), ("_x0", "_y0", "_x1", "_y1"), cell, inside,
                       levels=(1, 8))
    best = hits.groupBy(key).agg(F.min_by("_keep", "_turn").alias("_k"))
    return points.join(best, key, "left").select(points["*"], *[c(f"_k.{k}").alias(k) for k in keep], c("_k").isNotNull().alias("covered"))


def seed_nudge(points: DataFrame, regions: DataFrame, key: str, cell: float = 64) -> DataFrame:
    """Sum of the seeds of the regions around each point; a region without one counts as 1."""
    reg = regions.groupBy("x0", "y0", "side").agg(F.sum(F.coalesce("seed", F.lit(1))).alias("_seed")) \
        .select(c("x0").alias("_x0"), c("y0").alias("_y0"), (c("x0") + c("side")).alias("_x1"), (c("y0") + c("side")).alias("_y1"), "_seed")
    inside = (c("px") > c("_x0")) & (c("px") < c("_x1")) & (c("py") > c("_y0")) & (c("py") < c("_y1"))
    hits = bucket_join(points.select(key, "px", "py"), reg, point(c("px"), c("py")), ("_x0", "_y0", "_x1", "_y1"), cell, inside, levels=(1, 8))
    total = hits.groupBy(key).agg(F.sum("_seed").alias("nudge"))
    return points.join(total, key, "left").select(key, F.coalesce("nudge", F.lit(0)).alias("nudge"))


# ------------------------------------------------------------------- semi and anti joins
def named_boxes(footprints: DataFrame) -> DataFrame:
    return footprints.select(*[b.alias(n) for b, n in zip(box(), ("bx0", "by0", "bx1", "by1"))])


def only_missing(candidates: DataFrame, footprints: DataFrame, cell: float = 32) -> DataFrame:
    """Candidates whose centre is in no existing building."""
    inside = (c("x") > c("bx0")) & (c("x") < c("bx1")) & (c("y") > c("by0")) & (c("y") < c("by1"))
    return bucket_join(candidates, named_boxes(footprints), point(c("x"), c("y")), ("bx0", "by0", "bx1", "by1"), cell, inside, "left_anti")


def touching_any(rows: DataFrame, gaps: DataFrame, key: str, cell: float = 128) -> DataFrame:
    """Rows whose box touches any gap rectangle."""
    g = gaps.select(c("x0").alias("bx0"), c("y0").alias("by0"), (c("x0") + c("side")).alias("bx1"), (c("y0") + c("side")).alias("by1"))
    return bucket_join(rows, g, box(), ("bx0", "by0", "bx1", "by1"), cell, how="left_semi", key=[key], levels=(1, 8))


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    dx = F.greatest(x0 - x, F.lit(0), x - x1)
    dy = F.greatest(y0 - y, F.lit(0), y - y1)
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def farther_than(points: DataFrame, footprints: DataFrame, distance: float, cell: float = 32) -> DataFrame:
    """Points more than `distance` from every building."""
    near = box_distance(c("x"), c("y"), c("bx0"), c("by0"), c("bx1"), c("by1")) <= distance
    return bucket_join(points, named_boxes(footprints), point(c("x"), c("y")), ("bx0", "by0", "bx1", "by1"), cell, near, "left_anti", reach=distance)


def without_overlap(rects: DataFrame, blockers: DataFrame, key: str, cell: float = 32) -> DataFrame:
    """Rectangles that share no square with a blocker. The plan may know of few rectangles that are still to be spread, so none is broadcast."""
    hit = boxes_overlap("x0", "y0", c("x0") + c("w"), c("y0") + c("h"), "bx0", "by0", "bx1", "by1")
    return bucket_join(rects, named_boxes(blockers), box(), ("bx0", "by0", "bx1", "by1"), cell, hit, "left_anti", key=[key], merge=True)


def not_near(points: DataFrame, served: DataFrame, reach: float) -> DataFrame:
    """Points with no served point within `reach` on both axes."""
    s = served.select(c("x").alias("_sx"), c("y").alias("_sy"))
    near = (F.abs(c("x") - c("_sx")) < reach) & (F.abs(c("y") - c("_sy")) < reach)
    return bucket_join(points, s, point(c("x"), c("y")), ("_sx", "_sy", "_sx", "_sy"), reach, near, "left_anti", reach=reach)


def unclaimed(points: DataFrame, claims: DataFrame, key: str = "pid") -> DataFrame:
    return points.join(claims.select(key), key, "left_anti")


# ------------------------------------------------------------------- neighbours
def neighbour_levels(buildings: DataFrame, radius: float = 120, least: int = 4) -> DataFrame:
    """Median tagged storeys within a radius; null when fewer than `least` buildings say."""
    centre = buildings.select("fid", (c("x0") + c("w") / 2).alias("cx"), (c("y0") + c("h") / 2).alias("cy"), "levels")
    tagged = centre.where("levels IS NOT NULL").groupBy(c("cx").alias("tx"), c("cy").alias("ty"), "levels").agg(F.count("*").alias("copies"))
    near = (c("cx") - c("tx")) * (c("cx") - c("tx")) + (c("cy") - c("ty")) * (c("cy") - c("ty")) <= radius * radius
    pairs = bucket_join(centre.select("fid", "cx", "cy"), tagged, point(c("cx"), c("cy")), ("tx", "ty", "tx", "ty"), radius, near, reach=radius)
    # Storeys take few values, so the median of each building comes from a short histogram.
    med = pairs.groupBy("fid").agg(F.sum("copies").alias("n"), F.percentile("levels", F.lit(0.5), c("copies")).alias("median")).where(c("n") >= least)
    return centre.select("fid").join(med, "fid", "left").select("fid", "median")


def lot_overlaps(lots: DataFrame, cell: float = 64) -> DataFrame:
    """Pairs of lots that share a square."""
    right = lots.select(c("fid").alias("other"), *[b.alias(n) for b, n in zip(box(), ("bx0", "by0", "bx1", "by1"))])
    hit = (c("fid") < c("other")) & boxes_overlap("x0", "y0", c("x0") + c("w"), c("y0") + c("h"), "bx0", "by0", "bx1", "by1")
    return bucket_join(lots, right, box(), ("bx0", "by0", "bx1", "by1"), cell, hit).select("fid", "other")


def nearest_segment(points: DataFrame, segs: DataFrame, key: str, reach: float, order: list[str], cell: float | None = None) -> DataFrame:
    """Each point's nearest segment within `reach`: its columns, the distance and the fraction along it.

    `segs` has ax, ay, bx, by; `order` breaks ties.
    """
    near = P.segment_distance(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by"))
    rest = [n for n in segs.columns]
    sb = (F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))
    hits = bucket_join(points.select(key, "x", "y"), segs, point(c("x"), c("y")), sb, cell or 2 * reach, near <= reach, reach=reach)
    hits = hits.withColumn("dist", near).withColumn("t", P.segment_parameter(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by")))
    best = hits.groupBy(key).agg(F.min_by(F.struct(*rest, "dist", "t"), F.struct("dist", *order)).alias("s"))
    return best.select(key, "s.*")


# ------------------------------------------------------------------- tiles
def explode_tiles(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per tile of a rectangle. Rectangles are dealt out first: a small file of them is one task otherwise."""
    return (df.repartition("x0", "y0").select(*keep, F.explode(F.sequence(c("y0"), c("y0") + c("h") - 1)).alias("ty"), "x0", "w")
              .select(*keep, "ty", F.explode(F.sequence(c("x0"), c("x0") + c("w") - 1)).alias("tx")))


def party_walls(owned: DataFrame) -> DataFrame:
    """Walls between tiles of different buildings: (fid, x, y, side, storeys of the neighbour).

    `owned` is stretches of rows with their fid and levels (`painter.claimed`). An edge is
    named by the tile south or east of it, and is a wall of both buildings.
    """
    faces = F.array(F.struct("one", "other"), F.struct(c("other").alias("one"), c("one").alias("other")))
    walls = painter.borders(owned, "fid", ["levels"]).select(F.explode(F.sequence(c("x0"), c("x1") - 1)).alias("x"), "y", "side", faces.alias("_f"))
    return walls.select("x", "y", "side", F.explode("_f").alias("_f")).select("_f.one.fid", "x", "y", "side", c("_f.other.levels").alias("storeys"))


def weight_under(footprints: DataFrame, ground: DataFrame) -> DataFrame:
    """Sum of ground weights under each footprint. `ground` is runs (ty, x0, x1, weight); those of one weight that overlap count once.

    Runs of both meet in blocks of rows. The plan knows their number before they are
    spread over rows only, so it is told to sort and merge, not to broadcast.
    """
    under = painter.in_blocks(painter.box_runs(footprints, ["fid"]), ["fid"], painter.NEAR)
    over = painter.pieces(ground, ["weight"]).select("ty", "_b", "weight", c("x0").alias("_g0"), c("x1").alias("_g1"))
    shared = F.least("x1", "_g1") - F.greatest("x0", "_g0")
    hit = under.hint("merge").join(over, ["ty", "_b"]).where("x0 < _g1 AND _g0 < x1").groupBy("fid").agg(F.sum(shared * c("weight")).alias("weight"))
    return footprints.select("fid").join(hit, "fid", "left").select("fid", F.coalesce("weight", F.lit(0)).alias("weight"))


def edge_crossing_anti(edges: DataFrame, tarmac: DataFrame, built: DataFrame) -> DataFrame:
    """Boundary edges that stay: not across a road, not inside a building.

    An edge has a first tile (ax, ay) and a second (bx, by). One grouped pass
    over both tiles of each edge replaces a join per side.
    """
    marks = tarmac.select("tx", "ty", F.lit(1).alias("road"), F.lit(0).alias("house")) \
        .unionByName(built.select("tx", "ty", F.lit(0).alias("road"), F.lit(1).alias("house"))) \
        .groupBy("tx", "ty").agg(F.max("road").alias("road"), F.max("house").alias("house"))
    sides = edges.select("eid", F.explode(F.array(F.struct(c("ax").alias("tx"), c("ay").alias("ty")), F.struct(c("bx").alias("tx"), c("by").alias("ty")))).alias("s")) \
        .select("eid", "s.tx", "s.ty")
    shut = sides.join(marks, ["tx", "ty"]).groupBy("eid").agg(F.sum("road").alias("r"), F.sum("house").alias("b")).where("r = 2 OR b = 2")
    return edges.join(shut.select("eid"), "eid", "left_anti")


def feature_cells(features: DataFrame, key: str, size: int = 300) -> DataFrame:
    """(key, cx, cy) for every cell a feature's box meets."""
    b = (c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h"))
    return explode_cells(features, b, size).select(key, "cx", "cy")


def push_off_road(points: DataFrame, segs: DataFrame, need: float, cell: float = 16.0, push: float = 18.0, rounds: int = 6) -> DataFrame:
    """Move points away from the road that crowds them most; drop those that cannot be cleared.

    Up to six moves. A point moves less than `push` in all, so the segments that any move can
    meet are joined once, and the moves are folded over that array. `segs` has ax, ay, bx, by,
    half and sid; each reaches as far as its own half width asks. `cell` is the least side of
    the buckets: points are copied to the cells in their reach, segments to those they touch.
    """
    reach, h = push + need + 1e-6, c("half")
    sb = (F.least("ax", "bx") - h, F.least("ay", "by") - h, F.greatest("ax", "bx") + h, F.greatest("ay", "by") + h)
    around = (c("x") - reach, c("y") - reach, c("x") + reach, c("y") + reach)
    near = P.segment_distance(c("x"), c("y"), c("ax"), c("ay"), c("bx"), c("by")) <= reach + h
    seg = F.struct("ax", "ay", "bx", "by", "half", "sid")
    points = points.select("pid", "x", "y")
    pairs = bucket_join(points, segs.select("ax", "ay", "bx", "by", "half", "sid"), around, sb, max(cell, 3 * reach), near, merge=True)
    both = pairs.select("pid", "x", "y", seg.alias("s")).unionByName(points.withColumn("s", F.lit(None)))
    met = both.groupBy("pid", "x", "y").agg(F.collect_list("s").alias("_segs"))

    def crowds(s: Column, x: Column, y: Column) -> Column:
        """How far a segment crowds a place, and from where; null if it does not."""
        t = P.segment_parameter(x, y, s["ax"], s["ay"], s["bx"], s["by"])
        off = F.transform(F.array(t), lambda t: F.struct((x - (s["ax"] + t * (s["bx"] - s["ax"]))).alias("dx"), (y - (s["ay"] + t * (s["by"] - s["ay"]))).alias("dy")))
        far = lambda d: F.sqrt(d["dx"] * d["dx"] + d["dy"] * d["dy"])
        wide = need + s["half"]
        return F.get(F.transform(off, lambda d: F.when(far(d) < wide, F.struct((wide - far(d)).alias("gap"), (-s["sid"]).alias("o"), d["dx"].alias("dx"), d["dy"].alias("dy")))), F.lit(0))

    def beside(s: Column, x: Column, y: Column) -> Column:
        """Whether a place lies in a segment's box, a test much cheaper than the distance."""
        wide = s["half"] + (need + 1e-6)
        inside = lambda v, a, b: (v <= F.greatest(s[a], s[b]) + wide) & (v >= F.least(s[a], s[b]) - wide)
        return inside(x, "ax", "bx") & inside(y, "ay", "by")

    def state(x: Column, y: Column, left: Column, clear: Column, open_: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"), left.alias("left"), clear.alias("clear"), open_.alias("open"))

    yes, no = F.lit(True), F.lit(False)

    def move(s: Column) -> Column:
        worst = F.array_max(F.transform(F.filter("_segs", lambda g: beside(g, s["x"], s["y"])), lambda g: crowds(g, s["x"], s["y"])))

        def by(m: Column) -> Column:
            length, step = F.sqrt(m["dx"] * m["dx"] + m["dy"] * m["dy"]), m["gap"] + 0.5
            go = (length >= 1e-6) & (step <= s["left"]) & (s["left"] - step > 0)
            gone = state(s["x"], s["y"], s["left"], no, no)
            moved = state(s["x"] + m["dx"] / length * step, s["y"] + m["dy"] / length * step, s["left"] - step, no, yes)
            return F.when(m.isNull(), state(s["x"], s["y"], s["left"], yes, no)).when(go, moved).otherwise(gone)

        return F.get(F.transform(F.array(worst), by), F.lit(0))

    start = state(c("x"), c("y"), F.lit(float(push)), no, yes)
    end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda s, _: F.when(s["open"], move(s)).otherwise(s))
    return met.select("pid", end.alias("s")).where("s.clear").select("pid", "s.x", "s.y")


def cells_inside(shape_edges: DataFrame, cells: DataFrame, size: int = 300) -> DataFrame:
    """Cells wholly inside a polygon: no edge passes through and the centre is inside.

    `shape_edges` has ax, ay, bx, by, one row per edge. Crossing parity is
    counted per cell over the edges that span its centre's row.
    """
    cut_cells = explode_cells(shape_edges, (F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by")), size, "cx", "cy")
    inner = (c("cx") * size + 1e-6, c("cy") * size + 1e-6, (c("cx") + 1) * size - 1e-6, (c("cy") + 1) * size - 1e-6)
    crossed = cut_cells.where(P.segment_hits_box(c("ay"), c("ax"), c("by"), c("bx"), inner[1], inner[0], inner[3], inner[2])) \
        .select("cx", "cy").distinct()
    mid_y = (c("cy") + 0.5) * size
    rows = shape_edges.withColumn("cy", F.explode(F.sequence(F.floor(F.least("ay", "by") / size - 0.5), F.ceil(F.greatest("ay", "by") / size - 0.5)))) \
        .where((c("ay") > mid_y) != (c("by") > mid_y)) \
        .select("cy", ((c("bx") - c("ax")) * (mid_y - c("ay")) / (c("by") - c("ay")) + c("ax")).alias("cross_x"))
    parity = cells.join(small(rows), "cy").where((c("cx") + 0.5) * size < c("cross_x")).groupBy("cx", "cy").agg((F.count("*") % 2).alias("odd"))
    return cells.join(parity.where("odd = 1").select("cx", "cy"), ["cx", "cy"], "left_semi").join(crossed, ["cx", "cy"], "left_anti")
