"""Running sums and carried values over long ordered groups.

A window over a whole group puts the group into one task. That is fine while
the whole input fits a task, which is checked first. Beyond that each group is
cut into blocks of consecutive positions: a window inside the block, a window
over one row per block, and a join of the two. A block holds at most `block`
rows, so a group with a third of the data still spreads over the cluster.
Both ways give the same rows; `force` takes the second one in tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, fits_one_task, input_bytes

BLOCK = 1 << 16


def prefix_sum(df: DataFrame, group: list[str], pos: str, value: Column, out: str, block: int = BLOCK,
               inclusive: bool = True, force: bool = False) -> DataFrame:
    """Running sum of `value` by `pos` within `group`. `pos` is an integer unique in the group."""
    if not force and fits_one_task(df):
        whole = W.partitionBy(*group).orderBy(pos).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(whole), F.lit(0)))
    keys = group + ["_blk"]
    df = df.withColumn("_blk", F.floor(F.col(pos) / block)).withColumn("_v", value)
    local = W.partitionBy(*keys).orderBy(pos)
    frame = local.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    totals = df.groupBy(*keys).agg(F.sum("_v").alias("_t"))
    before = W.partitionBy(*group).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1) if group \
        else W.orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    base = totals.withColumn("_base", F.sum("_t").over(before)).drop("_t")
    zero = F.lit(0)
    return (df.withColumn("_s", F.sum("_v").over(frame)).join(base, keys)
            .withColumn(out, F.coalesce(F.col("_s"), zero) + F.coalesce(F.col("_base"), zero))
            .drop("_blk", "_v", "_s", "_base"))


def carry(df: DataFrame, group: list[str], pos: str, values: dict[str, Column], forward: bool = True,
          block: int = BLOCK, inclusive: bool = False, force: bool = False) -> DataFrame:
    """The nearest non-null value before (or after) each row, for several columns at once."""
    if not force and fits_one_task(df):
        whole = W.partitionBy(*group).orderBy(pos)
        near = 0 if inclusive else (-1 if forward else 1)
        frame = whole.rowsBetween(W.unboundedPreceding, near) if forward else whole.rowsBetween(near, W.unboundedFollowing)
        pick = F.last if forward else F.first
        return df.select("*", *[pick(expr, ignorenulls=True).over(frame).alias(n) for n, expr in values.items()])
    keys = group + ["_blk"]
    df = df.withColumn("_blk", F.floor(F.col(pos) / block))
    tmp = {name: f"_v_{name}" for name in values}
    for name, expr in values.items():
        df = df.withColumn(tmp[name], expr)
    near = 0 if inclusive else (-1 if forward else 1)
    local, outer = W.partitionBy(*keys).orderBy(pos), W.partitionBy(*group).orderBy("_blk") if group else W.orderBy("_blk")
    if forward:
        frame, outside, pick = local.rowsBetween(W.unboundedPreceding, near), outer.rowsBetween(W.unboundedPreceding, -1), F.last
        ends = [F.max_by(tmp[n], F.when(F.col(tmp[n]).isNotNull(), F.col(pos))).alias(f"_e_{n}") for n in values]
    else:
        frame, outside, pick = local.rowsBetween(near, W.unboundedFollowing), outer.rowsBetween(1, W.unboundedFollowing), F.first
        ends = [F.min_by(tmp[n], F.when(F.col(tmp[n]).isNotNull(), F.col(pos))).alias(f"_e_{n}") for n in values]
    per_block = df.groupBy(*keys).agg(*ends)
    for n in values:
        per_block = per_block.withColumn(f"_o_{n}", pick(f"_e_{n}", ignorenulls=True).over(outside)).drop(f"_e_{n}")
        df = df.withColumn(f"_l_{n}", pick(tmp[n], ignorenulls=True).over(frame))
    df = df.join(per_block, keys)
    for n in values:
        df = df.withColumn(n, F.coalesce(f"_l_{n}", f"_o_{n}")).drop(f"_l_{n}", f"_o_{n}", tmp[n])
    return df.drop("_blk")


def with_next(df: DataFrame, group: list[str], pos: str, values: dict[str, str], block: int = BLOCK, force: bool = False) -> DataFrame:
    """Rows that have a successor in their group, with the successor's columns.

    `pos` counts by one. Past the size check, the first row of a block is
    copied into the block before it, so no join is needed.
    """
    if not force and fits_one_task(df):
        w = W.partitionBy(*group).orderBy(pos)
        out = df.select("*", *[F.lead(src).over(w).alias(name) for name, src in values.items()], F.lead(pos).over(w).alias("_np"))
        return out.where(F.col("_np").isNotNull()).drop("_np")
    own = F.floor(F.col(pos) / block)
    copies = F.when(F.pmod(F.col(pos), F.lit(block)) == 0, F.array(own - 1, own)).otherwise(F.array(own))
    w = W.partitionBy(*group, "_blk").orderBy(pos)
    out = df.withColumn("_blk", F.explode(copies))
    out = out.select("*", *[F.lead(src).over(w).alias(name) for name, src in values.items()], F.lead(pos).over(w).alias("_np"))
    return out.where(F.col("_np").isNotNull() & (F.col("_blk") == own)).drop("_np", "_blk")


def with_halo(df: DataFrame, axis: str, reach: int, block: int = 256) -> DataFrame:
    """Copy rows near a block edge into the neighbouring block.

    Adds `_blk` and `_own`. Windows partitioned by `_blk` then see everything
    within `reach`, and rows with `_own` false are dropped afterwards.
    """
    block = max(block, 2 * reach)
    lo, hi = F.floor((F.col(axis) - reach) / block), F.floor((F.col(axis) + reach) / block)
    return (df.withColumn("_blk", F.explode(F.sequence(lo, hi)))
              .withColumn("_own", F.col("_blk") == F.floor(F.col(axis) / block)))


def near_window(df: DataFrame, row: list[str], axis: str, reach: int, make: dict, block: int = 256) -> DataFrame:
    """Window columns over `axis` limited to `reach`, one bounded block at a time.

    `make` maps a name to a function of the ordered window.
    """
    part = W.partitionBy(*row, "_blk").orderBy(axis)
    out = with_halo(df, axis, reach, block)
    for name, fn in make.items():
        out = out.withColumn(name, fn(part))
    return out.where("_own").drop("_blk", "_own")


def global_rank(df: DataFrame, major: list[Column], minor: str, out: str = "rank", span: int = 4096, force: bool = False) -> DataFrame:
    """1-based rank by `major` (sort expressions as ascending columns), then by `minor`.

    A small table is sorted in one task. Otherwise rows are counted per (major,
    minor block) and the counts are summed in two levels, so no task sorts the
    whole table; `minor` is then an integer.
    """
    if not force and input_bytes(df) < BROADCAST_BYTES:
        return df.withColumn(out, F.row_number().over(W.orderBy(*major, minor)).cast("bigint"))
    names = [f"_m{i}" for i in range(len(major))]
    df = df.select("*", *[m.alias(n) for m, n in zip(major, names)]).withColumn("_mb", F.floor(F.col(minor) / span))
    blocks = df.groupBy(*names, "_mb").agg(F.count("*").alias("_n"))
    heads = blocks.groupBy(*names).agg(F.sum("_n").alias("_t"))
    # One row per distinct major value reaches this ordered sum.
    heads = heads.withColumn("_hb", F.coalesce(F.sum("_t").over(W.orderBy(*names).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    blocks = blocks.withColumn("_bb", F.coalesce(F.sum("_n").over(
        W.partitionBy(*names).orderBy("_mb").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = F.row_number().over(W.partitionBy(*names, "_mb").orderBy(minor))
    return (df.withColumn("_r", local).join(blocks, names + ["_mb"]).join(heads, names)
            .withColumn(out, (F.col("_r") + F.col("_bb") + F.col("_hb")).cast("bigint"))
            .drop(*names, "_mb", "_r", "_bb", "_hb"))
