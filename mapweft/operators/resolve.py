"""The kind of a building once everything known about it is in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.tags import case, isin


def c(name: str) -> Column:
    return F.col(name)


def resolve_building_kind(b: DataFrame, chance: float = 0.55, flats_tiles: int = 150, flats_near_m2: int = 60) -> DataFrame:
    """Adds `kind`. Order: own tags, mapped uses, sheds, neighbours, land, override or zone, size, then use rules.

    Columns: tagged, btag, has_uses, offices_only, m2, levels, nearby, land,
    override, zoned, zone_kind, hotel, theatre, draw. Each step is a column of
    its own so that no later CASE repeats an earlier one.
    """
    plain = c("tagged").isNull()
    used = case((c("has_uses") & c("offices_only") & (plain | isin(c("tagged"), ["house"])), "civic"),
                (c("has_uses") & ~c("offices_only") & (plain | isin(c("tagged"), ["house", "shed"])), "shop"), default=c("tagged"))
    shed = isin(c("btag"), V.SHED_VALUES) | (isin(c("btag"), ["", "yes"]) & (c("m2") <= V.SHED_MAX_M2))
    flats = F.coalesce(c("nearby") >= 3, F.lit(False)) & (c("m2") >= flats_near_m2) & ~isin(c("btag"), V.HOUSE_TAGS)
    tall_shop = isin(c("land"), ["shop"]) & F.coalesce(c("levels") >= 3, F.lit(False))
    placed = case((c("_k1").isNotNull(), c("_k1")), (shed, "shed"), (flats, "apartment"), (tall_shop, F.lit(None).cast("string")), default=c("land"))
    drawn = case((c("override").isNotNull(), c("override")), (plain & c("zoned"), c("zone_kind")), default=c("_k2"))
    small_home = isin(c("btag"), ["house", "detached", "bungalow"])
    big = case((c("levels") >= 3, True), (c("levels") == 1, False), (c("m2") < flats_tiles, False), (small_home, False), default=c("draw") < chance)
    sized = F.when(c("_k3").isNull() & big, F.lit("apartment")).otherwise(c("_k3"))
    over_shop = isin(c("_k4"), ["shop", "restaurant"]) & c("has_uses") & F.coalesce(c("levels") >= 3, F.lit(False)) \
        & ~isin(c("btag"), ["retail", "commercial", "supermarket", "shop", "kiosk"])
    final = case((c("override").isNotNull(), c("_k4")), (c("hotel"), "apartment"), (c("theatre"), "civic"),
                 (over_shop, F.when(c("offices_only"), F.lit("civic")).otherwise(F.lit("apartment"))), default=c("_k4"))
    return b.withColumn("_k1", used).withColumn("_k2", placed).withColumn("_k3", drawn).withColumn("_k4", sized) \
        .withColumn("kind", final).drop("_k1", "_k2", "_k3", "_k4")
