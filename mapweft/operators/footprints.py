"""Footprints on the ground: which side faces the street."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bucket import bucket_join


def c(name: str) -> Column:
    return F.col(name)


def street_side(buildings: DataFrame, paved: DataFrame, reach: int = 40) -> DataFrame:
    """(fid, side): the side with the nearest paved tile; ties go N, S, W, E; null beyond `reach`.

    Three sample tiles per side look outward along their row or column. What a sample
    sees is a box one tile wide, which meets the paved runs (ty, x0, x1) in buckets. Single
    tiles (tx, ty) are runs of one.
    """
    if "tx" in paved.columns:
        paved = paved.select("ty", c("tx").alias("x0"), (c("tx") + 1).alias("x1"))
    looks = []
    for i in (1, 2, 3):
        fx, fy = c("x0") + F.floor(c("w") * i / 4), c("y0") + F.floor(c("h") * i / 4)
        for order, (side, x, y, dx, dy) in enumerate((("north", fx, c("y0"), 0, -1), ("south", fx, c("y0") + c("h") - 1, 0, 1),
                                                      ("west", c("x0"), fy, -1, 0), ("east", c("x0") + c("w") - 1, fy, 1, 0))):
            low, high = (x + min(dx, 0) * reach, y + min(dy, 0) * reach), (x + max(dx, 0) * reach, y + max(dy, 0) * reach)
            looks.append(F.struct(F.lit(order).alias("o"), F.lit(side).alias("side"), x.alias("tx"), y.alias("ty"),
                                  low[0].alias("lx0"), low[1].alias("ly0"), high[0].alias("lx1"), high[1].alias("ly1")))
    asks = buildings.repartition("x0", "y0").select("fid", F.explode(F.array(*looks)).alias("s")).select("fid", "s.*")
    roads = paved.select(c("ty").alias("gy"), c("x0").alias("g0"), (c("x1") - 1).alias("g1"))
    hits = bucket_join(asks, roads, ("lx0", "ly0", "lx1", "ly1"), ("g0", "gy", "g1", "gy"), 32, merge=True)
    dist = F.greatest(F.abs(c("ty") - c("gy")), c("g0") - c("tx"), c("tx") - c("g1"))
    best = hits.withColumn("d", dist).groupBy("fid").agg(F.min(F.struct("d", "o", "side")).alias("m"))
    letter = F.upper(F.substring(c("m.side"), 1, 1))
    return buildings.select("fid").join(best, "fid", "left").select("fid", letter.alias("side"), c("m.d").alias("tiles"))
