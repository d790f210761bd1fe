"""Building tables: statistics, unit rows and ordered picks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as V
from . import scan


def c(name: str) -> Column:
    return F.col(name)


def house_stats(buildings: DataFrame, least: int = 5) -> DataFrame:
    """Per kind: median area, mean storeys, share above one storey, wall edges."""
    storeys = F.coalesce("levels", F.lit(1))
    return buildings.groupBy("kind").agg(
        F.count("*").alias("n"), F.percentile(c("w") * c("h"), 0.5).alias("median_tiles"), F.round(F.avg(storeys), 6).alias("mean_storeys"),
        F.round(100.0 * F.count_if(storeys > 1) / F.count("*"), 4).alias("multi_pct"), F.sum(2 * (c("w") + c("h"))).alias("wall_edges")).where(c("n") >= least)


def placement_order(buildings: DataFrame) -> DataFrame:
    """Rank of every building: landmarks first, then the largest, then the id."""
    housing = F.coalesce("kind", F.lit("house")).isin(V.HOUSING)
    return scan.global_rank(buildings, [housing.cast("int"), -(c("w") * c("h"))], "fid", "rank")


def row_units(buildings: DataFrame, metres_per_tile: float = 1.0) -> DataFrame:
    """Cut rows of units by frontage, then anything still too big for one building.

    Rectangles only need arithmetic: unit k of n runs from round(k*L/n) to round((k+1)*L/n).
    """
    long_m, short_m = F.greatest("w", "h") * metres_per_tile, F.least("w", "h") * metres_per_tile
    terrace = F.coalesce(c("btag").isin(V.TERRACE_TAGS), F.lit(False))
    row_kind = c("kind").isNull() | c("kind").isin(V.ROW_KINDS)
    fits = (row_kind | terrace) & (short_m >= 5.0) & (long_m >= 22.0) & (terrace | ((short_m <= 32.0) & (long_m >= short_m * 2.2)))
    base = F.when(F.coalesce("kind", F.lit("house")).isin("house", "apartment"), F.lit(9.0)).otherwise(F.lit(13.0))
    uses = F.coalesce("n_uses", F.lit(0))
    frontage = F.when(uses > 1, F.least(F.greatest(base, long_m / uses), base * 2)).otherwise(base)
    unit = F.greatest(F.lit(5), F.rint(frontage / metres_per_tile).cast("int"))
    n = F.when(fits, F.greatest(F.lit(1), F.rint(F.greatest("w", "h") / unit).cast("int"))).otherwise(F.lit(1))
    first = _split(buildings.withColumn("_n", n))
    side = max(8, int(6000.0**0.5 / max(0.05, metres_per_tile)))
    for _ in range(4):
        many = F.when(c("w") * c("h") > side * side, F.greatest(F.lit(1), F.rint(F.greatest("w", "h") / side).cast("int"))).otherwise(F.lit(1))
        first = _split(first.withColumn("_n", many))
    return first


def _split(df: DataFrame) -> DataFrame:
    along = c("w") >= c("h")
    length = F.greatest("w", "h")
    cut = df.withColumn("_k", F.explode(F.sequence(F.lit(0), c("_n") - 1)))
    a, b = F.rint(length * c("_k") / c("_n")).cast("bigint"), F.rint(length * (c("_k") + 1) / c("_n")).cast("bigint")
    keep = (c("_n") == 1) | ((b - a >= 5) & ((b - a) * F.least("w", "h") >= 16))
    return cut.where(keep).withColumn("_a", a).withColumn("_len", b - a).withColumn("_along", along) \
        .withColumn("x0", F.when(c("_along"), c("x0") + c("_a")).otherwise(c("x0"))) \
        .withColumn("y0", F.when(c("_along"), c("y0")).otherwise(c("y0") + c("_a"))) \
        .withColumn("w", F.when(c("_along"), c("_len")).otherwise(c("w"))) \
        .withColumn("h", F.when(c("_along"), c("h")).otherwise(c("_len"))).drop("_n", "_k", "_a", "_len", "_along")


def priority_pick(rows: DataFrame) -> DataFrame:
    """The one building to host the rare item: base, station, gun shop, a house far out, else the biggest.

    `rows` has file, kind, tile_x, tile_y, width, height, gunshop.
    """
    area = c("width") * c("height")
    cx, cy = c("tile_x") + c("width") / 2, c("tile_y") + c("height") / 2
    home = c("kind").isin("house", "apartment")
    stats = rows.agg(F.avg(cx).alias("mx"), F.avg(cy).alias("my"), F.count_if(home).alias("homes"))
    counts = rows.where(home).groupBy(area.alias("a")).agg(F.count("*").alias("n"))
    # Houses by size: how many are strictly larger, from one row per distinct size.

    above = F.coalesce(F.sum("n").over(W.orderBy(c("a").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = counts.withColumn("above", above).crossJoin(F.broadcast(stats)).withColumn("quota", F.greatest(F.lit(8), F.floor(c("homes") * 0.25).cast("int")))
    edge = sizes.where("above < quota").agg(F.min_by("a", "a").alias("least"), F.min_by("quota", "a").alias("quota"), F.min_by("above", "a").alias("over"))
    # The smallest size admitted may be admitted only in part, by file name.
    last = rows.where(home).join(F.broadcast(edge), area == c("least")).select("file", "quota", "over")
    cut = last.groupBy().agg(F.max(c("quota") - c("over")).alias("k"))
    part = scan.global_rank(last.withColumn("_i", F.lit(0)), [c("file")], "_i", "r").crossJoin(F.broadcast(cut)).where("r <= k").select("file")
    wide = rows.where(home).join(F.broadcast(edge), area > c("least"), "left_semi").select("file").union(part)
    far = rows.join(wide, "file", "left_semi").crossJoin(F.broadcast(stats))
    dist = F.sqrt((cx - c("mx")) * (cx - c("mx")) + (cy - c("my")) * (cy - c("my")))
    house = far.select("file", "kind", F.struct(F.lit(1).alias("p"), F.round(dist, 9).alias("s"), c("file").alias("f")).alias("k"), F.lit("house").alias("found_as"))

    def tier(where, p, name):
        return rows.where(where).select("file", "kind", F.struct(F.lit(p).alias("p"), area.cast("double").alias("s"), c("file").alias("f")).alias("k"), F.lit(name).alias("found_as"))

    every = tier(c("kind") == "military", 4, "military").union(tier(c("kind") == "police", 3, "police")) \
        .union(tier(c("gunshop"), 2, "gunshop")).union(house).union(tier(F.lit(True), 0, "any"))
    return every.groupBy().agg(F.max_by(F.struct("file", "kind", "found_as"), "k").alias("m")).select("m.*").where("file IS NOT NULL")


def first_uses(rows: DataFrame, key: str, use: str = "use", order: str = "ord", limit: int = 8) -> DataFrame:
    """(key, uses): the first distinct uses of each key in order, at most `limit`.

    Each use counts where it comes first. Equal places go by the use's name.
    """
    once = rows.where(c(use).isNotNull()).groupBy(key, use).agg(F.min(order).alias("_o"))
    along = W.partitionBy(key).orderBy("_o", use)
    kept = once.withColumn("_i", F.row_number().over(along)).where(c("_i") <= limit)
    return kept.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", use))), lambda u: u[use]).alias("uses"))


def capped(rows: DataFrame, caps: dict[str, int], kind: str = "kind", order: str = "ord") -> DataFrame:
    """The first rows of each kind by `order`, as many as its cap allows; kinds without a cap stay whole."""
    rest = rows.where(~c(kind).isin(list(caps)))
    return reduce(DataFrame.unionByName, [rows.where(c(kind) == k).orderBy(order).limit(n) for k, n in caps.items()], rest)
