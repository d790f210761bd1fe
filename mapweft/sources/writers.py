"""Writers: partitioned grids, layers, junctions, manifests, placements, census and footprints.

Each format has a function that shapes the rows and one that writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as V
from ..operators import scan


def c(name: str) -> Column:
    return F.col(name)


# ------------------------------------------------------------------- grids
def feature_grid(features: DataFrame, box: tuple[float, float, float, float], most: int = 32) -> DataFrame:
    """Copies of features (s, w, n, e) per clip cell: is_cover, row, col.

    The clip box is cut into round(size / 0.2 degrees) rows and columns, 1 to
    16. Features over more than `most` cells are stored once as cover.
    """
    s, w, n, e = box
    rows, cols = max(1, min(16, round((n - s) / 0.2))), max(1, min(16, round((e - w) / 0.2)))

    def index(v, lo, hi, count):
        return F.greatest(F.lit(0), F.least(F.lit(count - 1), F.floor((v - lo) / (hi - lo) * count))).cast("int")

    inside = ~((c("n") < s) | (c("s") > n) | (c("e") < w) | (c("w") > e))
    df = features.where(inside).withColumn("_r0", index(c("s"), s, n, rows)).withColumn("_r1", index(c("n"), s, n, rows)) \
        .withColumn("_c0", index(c("w"), w, e, cols)).withColumn("_c1", index(c("e"), w, e, cols))
    count = (c("_r1") - c("_r0") + 1) * (c("_c1") - c("_c0") + 1)
    covers = (count > most) | ((c("s") <= s) & (c("n") >= n) & (c("w") <= w) & (c("e") >= e))
    cells = F.flatten(F.transform(F.sequence("_r0", "_r1"), lambda r: F.transform(F.sequence("_c0", "_c1"), lambda k: F.struct(r.alias("row"), k.alias("col")))))
    once = F.array(F.struct(F.lit(-1).alias("row"), F.lit(-1).alias("col")))
    return df.withColumn("is_cover", covers).withColumn("_cell", F.explode(F.when(covers, once).otherwise(cells))) \
        .withColumn("row", c("_cell.row")).withColumn("col", c("_cell.col")).drop("_r0", "_r1", "_c0", "_c1", "_cell")


def region_grid(features: DataFrame, step: float = 0.25, widest: int = 4) -> DataFrame:
    """Copies of features per fixed grid cell; those wider than `widest` cells are stored once at row -1."""
    r0, r1, c0, c1 = [F.floor(c(k) / step).cast("int") for k in ("s", "n", "w", "e")]
    df = features.withColumn("_r0", r0).withColumn("_r1", r1).withColumn("_c0", c0).withColumn("_c1", c1)
    wide = (c("_r1") - c("_r0") >= widest) | (c("_c1") - c("_c0") >= widest)
    minus = F.array(F.lit(-1))
    df = df.withColumn("row", F.explode(F.when(wide, minus).otherwise(F.sequence("_r0", "_r1")))) \
        .withColumn("col", F.explode(F.when(c("row") == -1, minus).otherwise(F.sequence("_c0", "_c1"))))
    return df.drop("_r0", "_r1", "_c0", "_c1")


def write_grid(grid: DataFrame, path: str, extra: list[str] | None = None, salts: int = 1) -> None:
    """Partitioned Parquet. Rows meet in one task per cell before the write, a hot cell in `salts` tasks."""
    keys = (extra or []) + ["row", "col"]
    spread = [c(k) for k in keys] + ([F.pmod(F.xxhash64("s", "w", "n", "e"), F.lit(salts))] if salts > 1 else [])
    grid.repartition(*spread).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_feature_table(features: DataFrame, path: str, box: tuple[float, float, float, float], version: int = V.FILTERS_VERSION) -> None:
    stamped = features.withColumn("filters_version", F.lit(version))
    for name, v in zip(("s", "w", "n", "e"), box):
        stamped = stamped.withColumn(f"box_{name}", F.lit(float(v)))
    stamped.write.mode("overwrite").partitionBy("filters_version").parquet(path)


# ------------------------------------------------------------------- JSON
def layer_features(df: DataFrame, fid: Column, layer: str, props: list[str], ring: Column) -> DataFrame:
    """One GeoJSON feature per row; `ring` is the outer ring as an array of [x, y]. Inner rings are left out."""
    p = F.struct(F.lit(layer).alias("layer"), *[c(k) for k in props])
    g = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return df.select(fid.alias("id"), F.to_json(F.struct(F.lit("Feature").alias("type"), fid.alias("id"), p.alias("properties"), g.alias("geometry"))).alias("json"))


def junction_rows(junctions: DataFrame) -> DataFrame:
    """Junctions numbered in (y, x) order of their centres, without one global sort."""
    ranked = scan.global_rank(junctions, [c("y")], "x", "no")
    return ranked.select("no", F.to_json(F.struct(c("no").alias("id"), "type", F.array("x", "y").alias("centre"))).alias("json"))


def piece_manifest(pieces: DataFrame, parent: str) -> DataFrame:
    """Manifest rows, one per piece, with the parent's name on each."""
    return pieces.select(F.lit(parent).alias("parent"), F.concat(F.lit(f"{parent}__r"), c("row").cast("string"), F.lit("_c"), c("col").cast("string")).alias("name"),
                         "row", "col", "x0", "y0", "tiles_w", "tiles_h")


def write_text(rows: DataFrame, path: str) -> None:
    rows.select("json").write.mode("overwrite").text(path)


# ------------------------------------------------------------------- tables
def placement_rows(rows: DataFrame) -> DataFrame:
    """Placements in file order: range-partitioned, so the written parts concatenate sorted."""
    return rows.orderBy("file")


def write_placements(rows: DataFrame, path: str) -> None:
    placement_rows(rows).write.mode("overwrite").csv(path, header=True)


def census_json(summary: DataFrame, places: DataFrame) -> DataFrame:
    """One row: the totals and the most populous places, which are a handful."""
    top = places.agg(F.sort_array(F.collect_list(F.struct((-c("population")).alias("p"), c("name").alias("name")))).alias("t"))
    return summary.crossJoin(F.broadcast(top)).select(*summary.columns, F.to_json(F.transform("t", lambda p: F.struct(p["name"].alias("name"), (-p["p"]).alias("population")))).alias("official"))


def footprint_rows(spans: DataFrame) -> DataFrame:
    """Footprints with their tiles as runs (ty, x0, x1): a rectangle is one run per row."""
    runs = F.transform(F.sequence(c("y0"), c("y0") + c("h") - 1), lambda y: F.struct(y.alias("ty"), c("x0").alias("x0"), (c("x0") + c("w")).alias("x1")))
    return spans.select("fid", "kind", "levels", "x0", "y0", runs.alias("runs"))


def store_footprints(spans: DataFrame, path: str) -> None:
    footprint_rows(spans).write.mode("overwrite").parquet(path)


def load_footprints(df: DataFrame) -> DataFrame:
    """Stored footprints as spans (fid, kind, levels, tiles, x0, y0, w, h), one per run."""
    tiles = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["x1"] - r["x0"])
    return df.select("fid", "kind", "levels", tiles.alias("tiles"), F.explode("runs").alias("r")) \
        .select("fid", "kind", "levels", "tiles", c("r.x0").alias("x0"), c("r.ty").alias("y0"), (c("r.x1") - c("r.x0")).alias("w"), F.lit(1).alias("h"))
