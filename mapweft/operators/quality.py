"""Checks on tables: misplaced rows, seams, repeatability, bad requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.tags import case
from .bucket import explode_cells


def c(name: str) -> Column:
    return F.col(name)


def reassign_out_of_cell(placements: DataFrame, width: int, height: int, cell: int = V.CELL) -> DataFrame:
    """Placements with their right cell and a reason: kept, moved, or why they are dropped."""
    cx, cy = F.floor(c("x0") / cell), F.floor(c("y0") / cell)
    missing = c("x0").isNull() | c("y0").isNull() | c("w").isNull() | c("h").isNull()
    outside = (c("x0") < 0) | (c("y0") < 0) | (c("x0") + c("w") > width) | (c("y0") + c("h") > height)
    reason = case((missing, "not a number"), ((c("w") <= 0) | (c("h") <= 0), "no size"), (outside, "outside"),
                  ((c("cx") != cx) | (c("cy") != cy), "moved"), default="kept")
    return placements.withColumn("reason", reason).withColumn("cx", cx).withColumn("cy", cy)


def seam_check(features: DataFrame, side: int) -> DataFrame:
    """Features that more than one piece must show."""
    spread = explode_cells(features, (c("x0"), c("y0"), c("x0") + c("w"), c("y0") + c("h")), side)
    return spread.groupBy("fid").agg(F.count("*").alias("pieces")).where("pieces > 1")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that two runs do not share, counted; zero when they are equal."""
    cols = a.columns
    both = a.groupBy(*cols).agg(F.count("*").alias("_n"), F.lit(0).cast("bigint").alias("_m")) \
        .unionByName(b.select(*cols).groupBy(*cols).agg(F.lit(0).cast("bigint").alias("_n"), F.count("*").alias("_m")))
    per_row = both.groupBy(*cols).agg(F.sum("_n").alias("n"), F.sum("_m").alias("m"))
    return per_row.agg(F.coalesce(F.sum(F.abs(c("n") - c("m"))), F.lit(0)).alias("differences"))


def selection_guard(n_points: Column, area: Column, max_points: int = 20000, min_area: float = 1e-6) -> Column:
    return case((n_points > max_points, "too many points"), (area < min_area, "no area"), default="ok")


def clip_classify(pts: Column, s: Column, w: Column, n: Column, e: Column) -> Column:
    """How a way (points x, y) relates to a box: hit, cover (the box lies inside its ring) or miss.

    The ring's own box is tested first, so most ways never reach the segment test.
    """
    from ..functions import geo as P

    def test(p):
        b = P.bounds(p)
        apart = ~P.boxes_meet(b["y0"], b["x0"], b["y1"], b["x1"], s, w, n, e)
        hit = F.exists(P.segments(p), lambda g: P.segment_hits_box(g["a"]["y"], g["a"]["x"], g["b"]["y"], g["b"]["x"], s, w, n, e))
        ring = F.get(p, F.lit(0)) == F.get(p, F.size(p) - 1)
        return case((apart, "miss"), (hit, "hit"), (ring & P.point_in_ring(p, w, s), "cover"), default="miss")

    return P.let(pts, test)
