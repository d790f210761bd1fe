"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, store


def _mark(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every endpoint; the component is its smallest id.

    Each round is two group-bys with map-side minimums and two joins, and
    halves the distance to the smallest id, so long chains need few rounds. It ends
    when a round changes nothing. Rounds are stored: the guesses of sizes that checkpoints
    keep would multiply, see `store`.
    """
    held = store(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")))
    ends = store(held.select("u").union(held.select("v")).distinct().withColumnRenamed("u", "id"))
    state = held.where("u <> v")
    seen = None
    while True:
        last, held = held, store(_small_star(_large_star(state)))
        release(last)
        state = held
        mark = tuple(_mark(state))
        if mark == seen:
            break
        seen = mark
    return (ends.join(state.select(F.col("u").alias("id"), F.col("v").alias("_c")), "id", "left")
            .select("id", F.coalesce("_c", "id").alias("component")))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u")
    return (linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
