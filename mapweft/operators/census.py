"""Population: floor area to people, people to chunks, chunks to a spawn value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.tags import isin, spatial_hash
from ..functions.text import lookup
from ..session import store


def c(name: str) -> Column:
    return F.col(name)


def occupants(kind: Column, tiles: Column, levels: Column, metres_per_tile: float = 1.0, m2_per_person: float = 45.0) -> tuple[Column, Column]:
    """(residents, daytime people) of a building."""
    floor = tiles * (metres_per_tile * metres_per_tile) * F.greatest(F.lit(1), F.coalesce(levels, F.lit(1)))
    home, shed = isin(kind, ["house", "apartment"]), isin(kind, ["shed"])
    rate = F.coalesce(lookup(kind, V.DAYTIME_M2_PER_PERSON), F.lit(V.DAYTIME_DEFAULT_M2))
    return (F.when(home, floor / m2_per_person).otherwise(F.lit(0.0)),
            F.when(home | shed, F.lit(0.0)).otherwise(floor / rate))


def people_per_chunk(spans: DataFrame, people: Column, tiles: Column, chunk: int = V.CHUNK) -> DataFrame:
    """(cx, cy, people): each building's people spread evenly over its tiles.

    `spans` are half-open rectangles (x0, y0, w, h) or one-row runs. A span is
    cut into chunks by arithmetic, so no tile is ever a row.
    """
    last_x, last_y = c("x0") + c("w") - 1, c("y0") + c("h") - 1
    per_tile = people / tiles
    cut = (spans.select("x0", "y0", "w", "h", per_tile.alias("_p"), last_x.alias("_lx"), last_y.alias("_ly"))
           .withColumn("cx", F.explode(F.sequence(F.floor(c("x0") / chunk), F.floor(c("_lx") / chunk))))
           .withColumn("cy", F.explode(F.sequence(F.floor(c("y0") / chunk), F.floor(c("_ly") / chunk)))))
    wide = F.least(c("_lx"), (c("cx") + 1) * chunk - 1) - F.greatest(c("x0"), c("cx") * chunk) + 1
    high = F.least(c("_ly"), (c("cy") + 1) * chunk - 1) - F.greatest(c("y0"), c("cy") * chunk) + 1
    return cut.groupBy("cx", "cy").agg(F.sum(c("_p") * wide * high).alias("people"))


def blur_5tap(grid: DataFrame, value: str, width: int | None = None, height: int | None = None) -> DataFrame:
    """[1 4 6 4 1]/16 each way with zeros outside the map, rescaled to keep the total."""
    taps = F.array(*[F.struct(F.lit(o).alias("o"), F.lit(k / 16.0).alias("k")) for o, k in zip(range(-2, 3), V.BLUR_WEIGHTS)])

    def spread(df, axis, size):
        other = "cy" if axis == "cx" else "cx"
        moved = df.select(other, F.explode(taps).alias("t"), axis, value) \
            .select(other, (c(axis) + c("t.o")).alias(axis), (c(value) * c("t.k")).alias(value))
        inside = (c(axis) >= 0) & ((c(axis) < size) if size else F.lit(True))
        return moved.where(inside).groupBy("cx", "cy").agg(F.sum(value).alias(value))

    # Both are read twice: for the totals and for the values.
    grid = store(grid)
    out = store(spread(spread(grid, "cx", width), "cy", height))
    before = grid.agg(F.sum(value).alias("_was"))
    after = out.agg(F.sum(value).alias("_now"))
    # Both totals are single rows.
    scale = F.broadcast(before.crossJoin(after))
    return out.crossJoin(scale).select("cx", "cy", F.when(c("_now") > 0, c(value) * c("_was") / c("_now")).otherwise(c(value)).alias(value))


def ground_share_per_chunk(ground: DataFrame, chunk: int = V.CHUNK) -> DataFrame:
    """(cx, cy, paved, water) shares. `ground` is runs (ty, x0, x1, value) that do not overlap, cut by arithmetic."""
    area = float(chunk * chunk)
    parts = ground.withColumn("cx", F.explode(F.sequence(F.floor(c("x0") / chunk), F.floor((c("x1") - 1) / chunk))))
    wide = F.least(c("x1"), (c("cx") + 1) * chunk) - F.greatest(c("x0"), c("cx") * chunk)
    share = lambda hit: (F.coalesce(F.sum(F.when(hit, wide)), F.lit(0)) / area)
    return parts.groupBy("cx", F.floor(c("ty") / chunk).alias("cy")).agg(
        share(c("value").isin(V.STREET_CLASSES)).alias("paved"), share(c("value") == V.GROUND_WATER).alias("water"))


def spawn_value(people: DataFrame, ground: DataFrame, per_resident: float = 1.0, cap: int = 10) -> DataFrame:
    """(cx, cy, density, value): blurred people plus street people, rounded by a keyed draw and capped."""
    people = store(people)
    soft = blur_5tap(people, "people").withColumnRenamed("people", "soft")
    both = people.join(soft, ["cx", "cy"], "full").join(ground, ["cx", "cy"], "full")
    zero = F.lit(0.0)
    dens = (1 - V.SPILL) * F.coalesce("people", zero) + V.SPILL * F.coalesce("soft", zero) + V.STREET_PEOPLE * F.coalesce("paved", zero)
    dens = F.when(F.coalesce("water", zero) > 0.5, zero).otherwise(dens)
    v = F.round(c("density") * (V.VALUE_PER_PERSON * per_resident), 9)
    draw = F.pmod(spatial_hash(c("cx"), c("cy")), F.lit(1000003)) / 1000003.0
    value = F.floor(c("v")) + F.when(draw < c("v") - F.floor(c("v")), F.lit(1)).otherwise(F.lit(0))
    return both.select("cx", "cy", dens.alias("density")).withColumn("v", v) \
        .select("cx", "cy", "density", F.greatest(F.lit(0), F.least(F.lit(cap), value)).cast("int").alias("value"))


def census_summary(spawn: DataFrame, totals: DataFrame, cap: int = 10) -> DataFrame:
    """One row of totals. `totals` has residents and daytime sums."""
    chunk = spawn.agg(F.count("*").alias("chunks"), F.count_if(c("value") > 0).alias("populated"), F.max("value").alias("peak"),
                      F.count_if(c("value") >= cap).alias("at_cap"), F.sum("value").alias("spawn_total"))
    return chunk.crossJoin(totals).select(
        "chunks", "populated", "peak", "at_cap", "spawn_total", F.round("residents").cast("bigint").alias("residents"),
        F.round("daytime").cast("bigint").alias("daytime"), F.round(c("populated") / c("chunks"), 4).alias("share"))


def density_grid(buildings: DataFrame, cell: int = 40) -> DataFrame:
    """(gx, gy, coverage): built share of a cell and its neighbours, 0..1.

    The map ends where its last cell with a building lies; at its edges a cell has fewer neighbours.
    """
    cells = store(buildings.groupBy(F.floor((c("x0") + c("w") / 2) / cell).alias("gx"), F.floor((c("y0") + c("h") / 2) / cell).alias("gy"))
                  .agg(F.sum(c("w") * c("h")).alias("built")))
    ends = cells.agg(F.max("gx").alias("_ex"), F.max("gy").alias("_ey"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    spread = cells.select(F.explode(steps).alias("s"), "gx", "gy", "built") \
        .select((c("gx") + c("s.i")).alias("gx"), (c("gy") + c("s.j")).alias("gy"), "built")
    sums = spread.groupBy("gx", "gy").agg(F.sum("built").alias("built")).crossJoin(F.broadcast(ends)) \
        .where((c("gx") >= 0) & (c("gy") >= 0) & (c("gx") <= c("_ex")) & (c("gy") <= c("_ey")))
    wide = lambda g, end: 1 + (c(g) > 0).cast("int") + (c(g) < c(end)).cast("int")
    return sums.select("gx", "gy", F.least(F.lit(1.0), c("built") / (wide("gx", "_ex") * wide("gy", "_ey") * cell * cell)).alias("coverage"))


def town_zones(placements: DataFrame, cell: int = V.CELL, margin: int = 8, least: int = 4) -> DataFrame:
    """One rectangle per cell around its buildings, clamped to the cell."""
    box = placements.groupBy(F.floor(c("x0") / cell).alias("cx"), F.floor(c("y0") / cell).alias("cy")).agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max(c("x0") + c("w")).alias("x1"), F.max(c("y0") + c("h")).alias("y1"))
    x0, y0 = F.greatest(c("x0") - margin, c("cx") * cell), F.greatest(c("y0") - margin, c("cy") * cell)
    x1, y1 = F.least(c("x1") + margin, (c("cx") + 1) * cell), F.least(c("y1") + margin, (c("cy") + 1) * cell)
    return box.select("cx", "cy", x0.alias("tile_x"), y0.alias("tile_y"), (x1 - x0).alias("width"), (y1 - y0).alias("height")) \
        .where((c("width") > least) & (c("height") > least))


def build_report(buildings: DataFrame, dims: list[str]) -> DataFrame:
    """Counts by each dimension and in total, in one pass with grouping sets."""
    sets = ", ".join(f"({d})" for d in dims) + ", ()"
    cols = ", ".join(dims)
    name = "CASE " + " ".join(f"WHEN grouping({d}) = 0 THEN '{d}'" for d in dims) + " ELSE 'total' END"
    value = "coalesce(" + ", ".join(f"CAST({d} AS STRING)" for d in dims) + ", 'all')"
    return buildings.sparkSession.sql(
        f"SELECT {name} AS dimension, {value} AS item, count(*) AS n, count(levels) AS measured, round(100.0 * count(levels) / count(*), 4) AS measured_pct "
        f"FROM {{b}} GROUP BY GROUPING SETS ({sets})", b=buildings)


def official_population(places: DataFrame, top: int = 5) -> DataFrame:
    """The most populous recorded places inside the map."""
    return places.where(c("population").isNotNull() & c("inside")).orderBy(c("population").desc(), "name", "id").limit(top)


def people_table(spark_buildings: DataFrame) -> DataFrame:
    """Buildings with residents, daytime people and tiles."""
    tiles = c("w") * c("h")
    res, day = occupants(c("kind"), tiles, c("levels"))
    return spark_buildings.withColumn("tiles", tiles).withColumn("residents", res).withColumn("daytime", day)

