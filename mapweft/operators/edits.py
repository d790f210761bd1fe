"""Edit overlays and stage stamps: folded, validated and compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tables as V
from ..functions.tags import case
from ..functions.text import version_key


def c(name: str) -> Column:
    return F.col(name)


def clean_patch(patches: DataFrame) -> DataFrame:
    """Patches with an `action`: set (validated value), clear, or skip.

    Columns: entity, field, value (text, null = clear).
    """
    v, field = c("value"), c("field")
    known = F.lit(False)
    for entity, fields in V.EDIT_FIELDS.items():
        known = known | ((c("entity") == entity) & field.isin(fields))
    whole = F.when(v.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(v).try_cast("int").cast("string"))
    pair = F.regexp_extract(v, r"^\s*\[?\s*(-?\d+)\s*,\s*(-?\d+)\s*\]?\s*$", 1), F.regexp_extract(v, r"^\s*\[?\s*(-?\d+)\s*,\s*(-?\d+)\s*\]?\s*$", 2)
    still = (pair[0].try_cast("int") == 0) & (pair[1].try_cast("int") == 0)
    clears = v.isNull() | ((field == "deleted") & (v == "false")) | ((field == "offset") & F.coalesce(still, F.lit(False))) \
        | (field.isin("kind", "style", "category") & (v == ""))
    cleaned = case((field.isin("levels", "seed", "population"), whole),
                   (field == "offset", F.when(pair[0] != "", F.concat_ws(",", *pair))),
                   (field == "deleted", F.when(v == "true", F.lit("true"))), default=v)
    action = case((~known, "skip"), (clears, "clear"), (cleaned.isNull(), "skip"), default="set")
    return patches.withColumn("action", action).withColumn("clean", F.when(c("action") == "set", cleaned))


def fold_edits(patches: DataFrame, keys: list[str], value: str = "value", seq: str = "seq") -> DataFrame:
    """Latest value per key; a null (clearing) latest patch removes the field.

    The maximum combines before the shuffle, so a much-edited record is one row per task.
    """
    last = patches.groupBy(*keys).agg(F.max(F.struct(c(seq).alias("seq"), c(value).alias("v"))).alias("m"))
    return last.where(c("m.v").isNotNull()).select(*keys, c("m.v").alias(value), c("m.seq").alias("seq"))


def merge_fold(state: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Fold a batch into a state that keeps clears as nulls, so late patches cannot undo them."""
    both = state.select(*keys, "value", "seq").unionByName(batch.select(*keys, "value", "seq"))
    return both.groupBy(*keys).agg(F.max(F.struct("seq", "value")).alias("m")).select(*keys, c("m.value").alias("value"), c("m.seq").alias("seq"))


def stages_of_field(entity: Column, field: Column) -> Column:
    """The stages an edited field makes necessary."""
    return case(
        ((entity == "building") & (field == "seed"), F.array(F.lit("reroll"))),
        ((entity == "building") & field.isin(V.PLACEMENT_FIELDS), F.array(F.lit("rebuild"))),
        ((entity == "area") & field.isin("category", "deleted"), F.array(F.lit("rebuild"), F.lit("repaint"))),
        (field.isin("name", "population") | entity.isin("place", "way"), F.array(F.lit("labels"))),
        default=F.array().cast("array<string>"))


def pending_stages(fields: DataFrame, key: str) -> DataFrame:
    """(key, stage): stages still to run for each map."""
    return fields.select(key, F.explode(stages_of_field(c("entity"), c("field"))).alias("stage")).distinct()


def affected_ids(fields: DataFrame) -> DataFrame:
    return fields.where((c("entity") == "building") & (c("field") == "seed")).select("id").distinct()


def stale_stages(stamps: DataFrame) -> DataFrame:
    """(map, stage): the first outdated stage of a map and every later stage it has.

    A map has at most four stages, so its window is four rows.
    """
    names = F.array(*[F.lit(s) for s in V.STAGES])
    changed = F.array(*[F.lit(V.STAGE_CHANGED_IN[s]) for s in V.STAGES])
    at = F.array_position(names, c("stage")).cast("int")
    old = version_key(c("version")) < version_key(F.get(changed, at - 1))
    w = W.partitionBy("map").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    return stamps.withColumn("_at", at).withColumn("_old", F.max(old).over(w)).where("_old").select("map", "stage")


def oldest_version(stamps: DataFrame) -> DataFrame:
    return stamps.where(c("version").isNotNull() & (c("version") != "")).groupBy("map").agg(F.min_by("version", version_key(c("version"))).alias("version"))


def stage_invalidation(runs: DataFrame) -> DataFrame:
    """Stamps that survive: a stage's latest run, unless an earlier stage ran after it.

    `runs` has map, stage, seq. The latest run per stage is four rows per map.
    """
    at = F.array_position(F.array(*[F.lit(s) for s in V.STAGES]), c("stage"))
    last = runs.groupBy("map", "stage").agg(F.max("seq").alias("seq")).withColumn("_at", at)
    earlier = F.max("seq").over(W.partitionBy("map").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    return last.withColumn("_e", earlier).where("_e IS NULL OR seq > _e").select("map", "stage", "seq")
