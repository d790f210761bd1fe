"""Vegetation, stalls and blocks on sparse tiles and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.tags import case, spatial_hash
from ..session import store
from . import painter as P
from . import tiles as R
from .graph import connected_components


def c(name: str) -> Column:
    return F.col(name)


def keyed(x: Column, y: Column, salt: int = 0) -> Column:
    """Uniform draw in [0, 1) from a position: the same for any partitioning."""
    return F.pmod(spatial_hash(x, y).bitwiseXOR(F.lit(salt * 83492791)), F.lit(1000003)) / 1000003.0


def clear_under(vegetation: DataFrame, paths: DataFrame, buildings: DataFrame) -> DataFrame:
    """Vegetation away from paths and buildings."""
    return vegetation.join(paths.select("tx", "ty").union(buildings.select("tx", "ty")), ["tx", "ty"], "left_anti")


def scatter_points(free: DataFrame, step: int = 11, clump: int = 70, density: float = 1.0) -> DataFrame:
    """One plant per accepted patch, on the patch's free tile with the least draw."""
    px, py = F.floor(c("tx") / step), F.floor(c("ty") / step)
    pick = free.groupBy(px.alias("px"), py.alias("py")).agg(F.min_by(F.struct("tx", "ty"), F.struct(keyed(c("tx"), c("ty"), 1).alias("u"), c("ty"), c("tx"))).alias("t"))
    thick = F.pow(keyed(F.floor(c("px") * step / clump), F.floor(c("py") * step / clump), 2), F.lit(1.6))
    take = keyed(c("px"), c("py"), 3) < F.least(F.lit(1.0), 0.75 * thick * density)
    kind = F.when(keyed(c("px"), c("py"), 4) < 0.45, F.lit("bush")).otherwise(F.lit("tree"))
    return pick.where(take).select("t.tx", "t.ty", kind.alias("kind"))


def lattice_in_polygon(boxes: DataFrame, key: str, step_x: int, step_y: int, blocked: DataFrame) -> DataFrame:
    """Lattice points of every rectangle (x0, y0, w, h), rows and columns from its corner, not on blocked runs (ty, x0, x1).

    A row of a rectangle meets what is blocked in blocks of the row, before it becomes points.
    """
    rows = boxes.select(key, "x0", (c("x0") + c("w")).alias("x1"), F.explode(F.sequence(c("y0"), c("y0") + c("h") - 1, F.lit(step_y).cast("bigint"))).alias("ty"))
    cut = rows.withColumn("_b", F.explode(F.sequence(F.floor(c("x0") / P.NEAR), F.floor((c("x1") - 1) / P.NEAR))))
    shut = P.pieces(blocked).groupBy("ty", "_b").agg(F.collect_list(F.struct("x0", "x1")).alias("_shut"))
    met = cut.hint("merge").join(shut, ["ty", "_b"], "left")
    low, high = F.greatest(c("x0"), c("_b") * P.NEAR), F.least(c("x1"), (c("_b") + 1) * P.NEAR) - 1
    first = low + F.pmod(c("x0") - low, F.lit(step_x))
    places = F.when(first <= high, F.sequence(first, high, F.lit(step_x).cast("bigint")))
    free = F.filter(places, lambda x: ~F.coalesce(F.exists("_shut", lambda s: (s["x0"] <= x) & (x < s["x1"])), F.lit(False)))
    return met.select(key, "ty", F.explode(free).alias("tx")).select(key, "tx", "ty")


def parking_zones(drives: DataFrame, lots: DataFrame, kerbs: DataFrame, density: float = 1.0) -> DataFrame:
    """Accepted stalls of the three sources, the first per 8x8 cell: drives, then lots, then kerbs row by row."""
    def source(df, order, chance):
        return df.where(keyed(c("tx"), c("ty"), order) <= F.least(F.lit(1.0), chance * density)).select("tx", "ty", "w", "h", F.lit(order).alias("src"))

    kerbs = kerbs.select("tx", "ty", "car_park", F.when(c("vertical"), 3).otherwise(5).alias("w"), F.when(c("vertical"), 5).otherwise(3).alias("h"))
    every = source(drives, 1, F.lit(0.6)).union(source(lots, 2, F.lit(0.55))) \
        .union(source(kerbs, 3, F.when(c("car_park"), 0.75).otherwise(0.45)))
    first = every.groupBy(F.floor(c("tx") / 8).alias("gx"), F.floor(c("ty") / 8).alias("gy")) \
        .agg(F.min_by(F.struct("tx", "ty", "w", "h", "src"), F.struct("src", "ty", "tx")).alias("s"))
    return first.select("s.*")


def palette_to_class(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """Colours (r, g, b) to ground classes through a small table; unknown colours are class 0."""
    return pixels.join(F.broadcast(palette), ["r", "g", "b"], "left").withColumn("value", F.coalesce("value", F.lit(V.GROUND_OTHER)))


def spawn_by_ground(tiles: DataFrame, ceiling: int = 10) -> DataFrame:
    """Fallback density from the ground alone: a chance and a range of the ceiling per kind of ground."""
    street, dirt, grass = c("value").isin(1, 2, 6, 7, 8), c("value") == 9, c("value").isin(3, 5)
    chance = case((street, 0.40), (dirt, 0.15), (grass, 0.03), default=0.08)
    lo = case((street, 0.4), (dirt, 0.2), default=0.1)
    hi = case((street, 1.0), (dirt, 0.5), (grass, 0.2), default=0.3)
    lucky = keyed(c("tx"), c("ty"), 5) <= chance
    level = F.rint(ceiling * (lo + (hi - lo) * keyed(c("tx"), c("ty"), 6))).cast("int")
    return tiles.select("tx", "ty", F.when((c("value") != V.GROUND_WATER) & lucky, level).otherwise(F.lit(0)).alias("spawn"))


# ------------------------------------------------------------------- connected ground
def label_runs(runs: DataFrame, block: int = 64) -> DataFrame:
    """Runs (ty, x0, x1) with a `piece` id: 4-connected pieces, named by their first run in row order.

    Runs are the nodes, so a plain of a million tiles is a few rows; touching
    runs of neighbouring rows meet through x blocks.
    """
    named = store(runs.select("ty", "x0", "x1", (c("ty") * F.lit(1 << 32) + c("x0")).alias("rid")))
    spread = named.withColumn("_b", F.explode(F.sequence(F.floor(c("x0") / block), F.floor((c("x1") - 1) / block))))
    below = spread.select((c("ty") - 1).alias("ty"), "_b", c("rid").alias("rid2"), c("x0").alias("bx0"), c("x1").alias("bx1"))
    pairs = spread.join(below, ["ty", "_b"]).where("x0 < bx1 AND bx0 < x1").select(c("rid").alias("src"), c("rid2").alias("dst"))
    comp = connected_components(pairs)
    return named.join(comp.withColumnRenamed("id", "rid"), "rid", "left").select("ty", "x0", "x1", F.coalesce("component", "rid").alias("piece"))


def connected_tiles(tiles: DataFrame) -> DataFrame:
    """(piece, tiles, x0, y0, x1, y1) for every 4-connected piece of a mask."""
    runs = label_runs(R.tile_runs(tiles))
    return runs.groupBy("piece").agg(F.sum(c("x1") - c("x0")).alias("tiles"), F.min("x0").alias("x0"), F.min("ty").alias("y0"),
                                     F.max("x1").alias("x1"), (F.max("ty") + 1).alias("y1"))


def open_runs(streets: DataFrame) -> DataFrame:
    """Runs between street runs inside the streets' own rectangle."""
    runs = R.tile_runs(streets)
    ext = runs.agg(F.min("ty").alias("r0"), F.max("ty").alias("r1"), F.min("x0").alias("c0"), F.max("x1").alias("c1"))
    rows = ext.select(F.explode(F.sequence("r0", "r1")).alias("ty"), "c0", "c1")
    # Sentinels at both edges, so that each gap is the space between two neighbours of a row.
    marks = runs.unionByName(rows.select("ty", c("c0").alias("x0"), c("c0").alias("x1"))).unionByName(rows.select("ty", c("c1").alias("x0"), c("c1").alias("x1")))
    nxt = F.lead("x0").over(W.partitionBy("ty").orderBy("x0", "x1"))
    return marks.select("ty", c("x1").alias("x0"), nxt.alias("x1")).where("x1 > x0")


def block_density(streets: DataFrame, built: DataFrame, least: int = 50, dense: float = V.DENSE, block: int = 64):
    """(blocks, runs): area, built tiles and density flag per enclosed block, and the block of every open run."""
    runs = label_runs(open_runs(streets))
    area = runs.groupBy("piece").agg(F.sum(c("x1") - c("x0")).alias("area"))
    spread = runs.withColumn("_b", F.explode(F.sequence(F.floor(c("x0") / block), F.floor((c("x1") - 1) / block))))
    hits = built.withColumn("_b", F.floor(c("tx") / block)).join(spread, ["ty", "_b"]).where("tx >= x0 AND tx < x1") \
        .groupBy("piece").agg(F.count("*").alias("built"))
    out = area.join(hits, "piece", "left").select("piece", "area", F.coalesce("built", F.lit(0)).alias("built"))
    return out.withColumn("dense", (c("area") > least) & (c("built") / c("area") >= dense)), runs


def pave_dense_blocks(blocks: DataFrame, runs: DataFrame, green: DataFrame) -> DataFrame:
    """Tiles of dense blocks that are not mapped green."""
    paved = runs.join(blocks.where("dense").select("piece"), "piece", "left_semi")
    return R.runs_to_tiles(paved, ["piece"]).join(green.select("tx", "ty"), ["tx", "ty"], "left_anti").select("tx", "ty")
