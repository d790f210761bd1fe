"""Contiguous shards of near-equal bytes, cut on global prefix sums. JVM only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.llm.prefix import with_prefix

# What each stored record costs besides its text.
RECORD_BYTES = 16


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal documents, in the order of their ids, into `shards` shards of near-equal bytes.

    A document goes to the shard in which its middle byte falls when the total is
    cut at equal targets; a shard is off its target by less than one document.
    Only id, size and checksum are shuffled, never the text. Returns id, size,
    text_crc32, shard and slot (gapless from 0 inside a shard).

    Null text: no bytes, checksum of the empty string. Null ids sort first.
    Repeated rows take neighbouring slots. Empty input: no rows. A document
    larger than a target leaves the shards that it covers empty. Other columns
    are not carried.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(RECORD_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_prefix(narrow, ["doc_id", "size", "text_crc32"], "size")
    total = narrow_total(placed)
    placed = placed.withColumn(
        "shard",
        F.expr(f"CAST(((2 * start + size) * {int(shards)}) div {2 * max(total, 1)} AS INT)"),
    )
    first = placed.groupBy("shard").agg(F.min("rank").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("_first")).alias("slot")
    )


def narrow_total(placed: DataFrame) -> int:
    """Sum of all sizes: one number."""
    return placed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
