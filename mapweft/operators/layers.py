"""Layers: overrides, labels, ordered exports and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as V


def c(name: str) -> Column:
    return F.col(name)


def base_plus_added(areas: DataFrame, edits: DataFrame, added: DataFrame, key: str = "aid") -> DataFrame:
    """Areas without the deleted ones, with new categories, and with the drawn ones."""
    patch = edits.select(key, c("deleted").alias("_del"), c("category").alias("_cat"))
    kept = areas.join(patch, key, "left").where(~F.coalesce("_del", F.lit(False))) \
        .withColumn("category", F.coalesce("_cat", "category")).drop("_del", "_cat")
    return kept.unionByName(added)


def area_overrides_paint(areas: DataFrame, edits: DataFrame, added: DataFrame) -> DataFrame:
    """The same, routed to the ground list, the vegetation list or both."""
    all_areas = base_plus_added(areas, edits, added)
    only_green = c("category").isin("forest", "scrub", "tree_single", "hedge")
    green = c("category").isin(V.VEGETATION_CATEGORIES)
    layers = F.filter(F.array(F.when(~only_green, F.lit("ground")), F.when(green, F.lit("vegetation"))), lambda v: v.isNotNull())
    return all_areas.select("aid", "category", F.explode(layers).alias("layer"))


def painter_order(tiles: DataFrame, value: str = "value", order: str = "ord", seq: str = "seq") -> DataFrame:
    """One value per tile: the one painted last. Partial maxima combine before the shuffle."""
    return tiles.groupBy("tx", "ty").agg(F.max_by(value, F.struct(order, seq)).alias(value))


def capped_layers(features: DataFrame, cap: int = V.MAX_LAYER_FEATURES, per_block: int = 4096) -> DataFrame:
    """At most `cap` features, the tail of each layer dropped in trim order.

    Layer sizes are five numbers. Places in a layer are counted by blocks of
    ids, so that a layer of any size is numbered without sorting it in one task.
    """
    blocks = features.withColumn("_b", F.floor(c("id") / per_block)).groupBy("layer", "_b").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("layer").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.withColumn("_base", F.coalesce(before, F.lit(0))).drop("_n")
    turn = F.array_position(F.array(*[F.lit(n) for n in V.LAYER_TRIM_ORDER]), c("layer"))
    sizes = features.groupBy("layer").agg(F.count("*").alias("_n")).withColumn("_turn", turn)
    total = F.sum("_n").over(W.partitionBy())
    gone = F.coalesce(F.sum("_n").over(W.orderBy("_turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), total - F.lit(cap) - gone)
    quota = sizes.select("layer", F.greatest(F.lit(0), c("_n") - extra).alias("_quota"))
    numbered = features.withColumn("_b", F.floor(c("id") / per_block)) \
        .withColumn("_r", F.row_number().over(W.partitionBy("layer", "_b").orderBy("id")))
    # The quota table has one row per layer, the block table one per few thousand ids.
    return numbered.join(F.broadcast(quota), "layer").join(blocks, ["layer", "_b"]) \
        .where(c("_r") + c("_base") <= c("_quota")).drop("_b", "_r", "_base", "_quota")


def label_table(buildings: DataFrame, water: DataFrame, grounds: DataFrame, places: DataFrame, overrides: DataFrame) -> DataFrame:
    """Labels (id, name, kind) of all sources, with renames and deletions applied."""
    top = buildings.where(c("kind").isin(V.LABELLED_KINDS) & (c("tiles") >= V.MIN_LABELLED_TILES) & c("name").isNotNull()) \
        .orderBy(c("tiles").desc(), "id").limit(V.MAX_BUILDING_LABELS).select("id", "name", F.lit("building").alias("kind"))
    lakes = water.where(c("tiles") >= V.MIN_PLACE_TILES).select("id", "name", F.lit("water").alias("kind"))
    land = grounds.where(c("tiles") >= V.MIN_PLACE_TILES).select("id", "name", F.lit("ground").alias("kind"))
    towns = places.select("id", "name", c("scale").alias("kind"))
    every = top.unionByName(lakes).unionByName(land).unionByName(towns)
    patch = overrides.select("id", c("name").alias("_name"), c("deleted").alias("_del"))
    out = every.join(patch, "id", "left").where(~F.coalesce("_del", F.lit(False)))
    return out.select("id", F.coalesce("_name", "name").alias("name"), "kind").where(c("name").isNotNull() & (c("name") != ""))
