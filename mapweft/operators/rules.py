"""Filtering features by the tag rule list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions import tags as G


def c(name: str) -> Column:
    return F.col(name)


def rule_rows() -> list[tuple[str, str, str | None, str | None]]:
    """Unique (kind, key, value, needs) rules; value None matches any value, needs names a tag that must be there too."""
    out = {}
    for kind, key, values in V.TAG_RULES:
        needs = "population" if (kind, key) == ("node", "place") else None
        for k in ("node", "way", "relation") if kind == "nwr" else (kind,):
            for value in values or [None]:
                out[(k, key, value, needs)] = None
    return list(out)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "kind string, key string, value string, needs string")


def rule_matches(features: DataFrame, rules: DataFrame, kind: str = "kind", tags: str = "t") -> DataFrame:
    """Every rule with the number of features that it matches.

    Tags are counted by kind, key, value and the conditions that rules name, before they
    meet the rules; that table is as long as there are different tags.
    """
    spread = features.select(c(kind).alias("kind"), F.explode(tags).alias("key", "value"), F.map_keys(tags).alias("_all"))
    needed = rules.where("needs IS NOT NULL").select("key", "needs").distinct()
    counted = spread.join(needed, "key", "left").withColumn("_met", F.when(F.array_contains("_all", c("needs")), c("needs"))) \
        .groupBy("kind", "key", "value", "_met").agg(F.count("*").alias("_n"))
    found = counted.withColumnsRenamed({"kind": "_k", "key": "_key", "value": "_val"})
    hit = (c("kind") == c("_k")) & (c("key") == c("_key")) & (c("value").isNull() | (c("value") == c("_val"))) & (c("needs").isNull() | c("needs").eqNullSafe(c("_met")))
    return rules.join(found, hit, "left").groupBy("kind", "key", "value", "needs").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))


def tag_rule_filter(features: DataFrame, kind: str = "kind", tags: str = "t") -> DataFrame:
    """Features that any rule keeps. The rules become one boolean, so nothing is shuffled."""
    return features.where(G.tag_rule_match(F.col(kind), F.col(tags)))


def tag_rule_filter_join(features: DataFrame, rules: DataFrame, kind: str = "kind", tags: str = "t") -> DataFrame:
    """The same for a rule table of any size: tags are exploded and semi-joined."""
    r = rules.select(c("kind").alias("_k"), c("key").alias("_key"), c("value").alias("_val"), c("needs").alias("_needs"))
    hit: Column = (c("_k") == c(kind)) & (c("_key") == c("_tag")) & (c("_val").isNull() | (c("_val") == c("_tagval"))) \
        & (c("_needs").isNull() | F.array_contains("_all", c("_needs")))
    spread = features.select("id", kind, F.map_keys(tags).alias("_all"), F.explode(tags).alias("_tag", "_tagval"))
    ids = spread.join(r, hit, "left_semi").select("id").distinct()
    return features.join(ids, "id", "left_semi")


def keep_referenced_ways(ways: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Ways a rule keeps, and ways that a kept relation refers to."""
    referenced = members.select(key).distinct().withColumn("_ref", F.lit(True))
    joined = ways.join(referenced, key, "left")
    return joined.where(G.tag_rule_match(F.col("kind"), F.col("t")) | F.col("_ref").isNotNull()).drop("_ref")


def promote_hot_keys(features: DataFrame, tags: str = "t") -> DataFrame:
    """Give the most filtered tags columns of their own, so Parquet statistics prune on them."""
    return features.select("*", *[F.col(tags)[k].alias(k) for k in V.HOT_KEYS])
