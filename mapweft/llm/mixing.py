"""Mix sources to target weights: capped water-filling and seeded repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.llm.prefix import with_prefix
from mapweft.session import cut

# Sources up to this many rows are broadcast (under 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 200_000


def word_count(text):
    """Number of runs of characters other than ASCII white space; null: 0."""
    words = F.split(F.coalesce(text, F.lit("")), "[ \t-\r]+")
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Add `target` to a table of (source, source_size, weight).

    The targets share the sum of all sizes by weight. Each round clamps the
    sources whose share exceeds `max_epochs` times their size and deals the
    excess to the rest by weight, until no share is above its limit. A round is
    one aggregation over the sources; only three numbers reach the driver.
    """
    cap = (F.col("source_size") * max_epochs).cast("double")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level, clamped = (total[0] / total[1] if total[1] else 0.0), -1
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        used, free, n = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * max_epochs)), F.lit(0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
            F.count(F.when(full, 1)),
        ).first()
        if n == clamped or not free:
            break
        level, clamped = (total[0] - used) / free, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Words that a mix of all sources takes of each document.

    Sources in code point order (null last) get the weights in turn. A source of
    size S with target t is read floor(t / S) times whole; the rest of its target
    is filled with documents in an order drawn from the seed and the id, up to
    the document whose middle passes the rest. No source and no document is read
    more than `max_epochs` times.

    Returns doc_id, source, size, source_size, target, taken and the `keep` columns. Null
    text has size 0, an empty source target 0. Repeated rows are taken one by one. Empty
    input: no rows. Reruns agree, because nothing depends on partitioning: rows of one id and
    size are told apart by a hash of their text. Texts of any length are only counted.
    """
    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.col(source_col).isNull().alias("_last"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_draw"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"), *[F.col(c) for c in keep],
    )
    # One global order serves every source: a source is a stretch of it, however large.
    placed = cut(with_prefix(narrow, ["_last", "source", "_draw", "doc_id", "size", "_words"], "size", "_rank", "_start"))
    sums = placed.groupBy("_last", "source").agg(F.sum("size").alias("source_size"), F.min("_start").alias("_source_start"))
    ranked = with_prefix(sums, ["_last", "source"], "source_size", "_order", "_ignored").drop("_ignored")
    choices = F.array(*[F.lit(w) for w in weights])
    sources = cut(ranked.withColumn("weight", F.element_at(choices, (F.col("_order") % len(weights) + 1).cast("int"))).drop("_order"))
    filled = water_fill(sources, max_epochs).select(
        F.col("source").alias("_source"), "source_size", "target", "_source_start",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).alias("_whole"),
    )
    if sources.count() <= BROADCAST_SOURCES:
        filled = F.broadcast(filled)
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    middle = 2 * (F.col("_start") - F.col("_source_start")) + F.col("size")
    return placed.join(filled, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("_whole") + F.when(middle < 2 * rest, 1).otherwise(0))).cast("long").alias("taken"),
        *keep,
    )
