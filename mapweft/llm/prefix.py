"""Prefix sums over a whole ordered table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mapweft.session import cut


def with_prefix(df: DataFrame, order: list[str], value: str, rank: str = "rank", start: str = "start") -> DataFrame:
    """Add each row's global rank (from 0) and the sum of `value` before it.

    The rows are dealt out by range, so every partition is one stretch of the
    order. Sums run inside a partition; one total per partition carries the
    rest, and that table has as many rows as there are partitions. The dealing
    is pinned by a checkpoint, because range bounds are sampled anew by each
    plan. Equal rows are told apart by an arrival number, so a pile of repeated
    rows is split as well. Null values count 0; nulls of the order come first.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*order, "_arrival"]
    dealt = cut(
        df.withColumn("_arrival", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .withColumn("_part", F.spark_partition_id())
    )
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    totals = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_v"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_v").over(before), F.lit(0)).alias("_sum_before"),
    )
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    # One row per partition of the shuffle: a broadcast whose size the setting bounds.
    return (
        dealt.join(F.broadcast(carried), "_part")
        .withColumn(rank, F.col("_rows_before") + F.count(F.lit(1)).over(inside) - 1)
        .withColumn(start, F.col("_sum_before") + F.sum(amount).over(inside) - amount)
        .drop("_part", "_arrival", "_rows_before", "_sum_before")
    )
