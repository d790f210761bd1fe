"""Map pieces: planning, dropping and shrinking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as V


def c(name: str) -> Column:
    return F.col(name)


def piece_plan(extent: DataFrame, side: int = V.CELL * V.PIECE_CELLS) -> DataFrame:
    """Pieces of a map of (width, height) tiles, row by row; the last ones may be smaller."""
    zero = F.lit(0).cast("bigint")
    rows = extent.select("*", F.explode(F.sequence(zero, F.greatest(zero, F.ceil(c("height") / side) - 1))).alias("row")) \
        .select("*", F.explode(F.sequence(zero, F.greatest(zero, F.ceil(c("width") / side) - 1))).alias("col"))
    return rows.select("row", "col", (c("col") * side).alias("x0"), (c("row") * side).alias("y0"),
                       F.least(F.lit(side), c("width") - c("col") * side).alias("tiles_w"), F.least(F.lit(side), c("height") - c("row") * side).alias("tiles_h"))


def drop_pieces(pieces: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces without the dropped ones; fails when none would be left."""
    left = pieces.join(dropped, keys, "left_anti")
    guard = left.agg(F.count("*").alias("_n")).select(F.when(c("_n") == 0, F.raise_error(F.lit("at least one piece must remain"))).otherwise(c("_n")).alias("_n"))
    return left.crossJoin(F.broadcast(guard)).drop("_n")


def fit_pieces(kept: DataFrame, cell: int = V.CELL, cells: int = V.PIECE_CELLS) -> DataFrame:
    """Pieces shrunk to their kept cells (cx, cy), flagged solid when no cell inside is missing."""
    wide, high = F.max("cx") - F.min("cx") + 1, F.max("cy") - F.min("cy") + 1
    return kept.groupBy(F.floor(c("cy") / cells).alias("row"), F.floor(c("cx") / cells).alias("col")).agg(
        (F.min("cx") * cell).alias("x0"), (F.min("cy") * cell).alias("y0"), (wide * cell).alias("tiles_w"), (high * cell).alias("tiles_h"),
        F.count("*").alias("kept"), (F.count("*") == wide * high).alias("solid"))
