"""Spatial joins by grid buckets.

Every spatial join here is an equi-join on grid cells plus the box test plus
the exact predicate. A pair that shares several cells is kept only in the cell
that owns the lower corner of the two boxes' overlap, so no `distinct` runs.
Objects much larger than a cell go to a coarser grid instead of being copied
into hundreds of cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import fits_one_task

Box = tuple  # (x0, y0, x1, y1), names or columns, edges included

# Rows of one side that a single cell may hold before it is salted.
HOT_CELL_ROWS = 200_000


def _c(v) -> Column:
    return F.col(v) if isinstance(v, str) else (v if isinstance(v, Column) else F.lit(v))


def point(x, y) -> Box:
    return (x, y, x, y)


def _floor(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("bigint")


def _spread(df: DataFrame, box: list[Column], sizes: list[float], own_level: bool, is_point: bool) -> DataFrame:
    """Add grid keys: the object's own level, or every level for the probing side."""
    size_arr = F.array(*[F.lit(float(s)) for s in sizes])
    if own_level and len(sizes) > 1:
        extent = F.greatest(box[2] - box[0], box[3] - box[1])
        level = F.lit(len(sizes) - 1)
        for i in range(len(sizes) - 2, -1, -1):
            level = F.when(extent <= 2.0 * sizes[i], F.lit(i)).otherwise(level)
        df = df.withColumn("_lvl", level)
    elif len(sizes) > 1:
        df = df.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(len(sizes) - 1))))
    else:
        df = df.withColumn("_lvl", F.lit(0))
    size = F.get(size_arr, F.col("_lvl")) if len(sizes) > 1 else F.lit(float(sizes[0]))
    if is_point:
        return df.withColumn("_cx", _floor(box[0], size)).withColumn("_cy", _floor(box[1], size))
    return (df.withColumn("_cx", F.explode(F.sequence(_floor(box[0], size), _floor(box[2], size))))
              .withColumn("_cy", F.explode(F.sequence(_floor(box[1], size), _floor(box[3], size)))))


def _salted(left: DataFrame, right: DataFrame, keys: list[str], hot_rows: int, force: bool):
    """Split cells that hold very many left rows; their right rows are copied per split.

    Counting costs a pass, so it runs only when the left side is big enough
    for one cell to overload a task.
    """
    if not force and fits_one_task(left):
        return left, right, keys
    hot = (left.groupBy(*keys).count().where(F.col("count") > hot_rows)
           .select(*keys, F.ceil(F.col("count") / hot_rows).cast("int").alias("_ways")))
    ways = F.coalesce(F.col("_ways"), F.lit(1))
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if not isinstance_map(left, c)])
    left = left.join(hot, keys, "left").withColumn("_salt", F.pmod(spread, ways).cast("int")).drop("_ways")
    right = (right.join(hot, keys, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), ways - 1))).drop("_ways"))
    return left, right, keys + ["_salt"]


def isinstance_map(df: DataFrame, name: str) -> bool:
    """Maps cannot be hashed, so they are left out of the salt."""
    return "map<" in df.schema[name].dataType.simpleString()


def bucket_join(
    left: DataFrame,
    right: DataFrame,
    left_box: Box,
    right_box: Box,
    cell: float,
    on: Callable[[], Column] | Column | None = None,
    how: str = "inner",
    reach: float = 0.0,
    key: list[str] | None = None,
    levels: tuple[int, ...] = (1,),
    hot_rows: int = HOT_CELL_ROWS,
    force_salt: bool = False,
    merge: bool = False,
) -> DataFrame:
    """Join rows whose boxes come within `reach` of each other and satisfy `on`.

    Column names must not clash. `how` is inner, left_semi or left_anti; for
    the last two a box-shaped left side needs its unique `key`. `merge` is for sides of
    many more rows than the plan estimates, so that none is broadcast.
    """
    lb, rb = [_c(v) for v in left_box], [_c(v) for v in right_box]
    is_point = left_box[0] is left_box[2] and left_box[1] is left_box[3]
    if not isinstance(left_box[0], Column):
        is_point = left_box[0] == left_box[2] and left_box[1] == left_box[3]
    sizes = [cell * m for m in levels]
    names = ["_rx0", "_ry0", "_rx1", "_ry1"]
    padded = [rb[0] - reach, rb[1] - reach, rb[2] + reach, rb[3] + reach]
    right = right.select("*", *[p.cast("double").alias(n) for p, n in zip(padded, names)])
    rx0, ry0, rx1, ry1 = [F.col(n) for n in names]
    right = _spread(right, [rx0, ry0, rx1, ry1], sizes, True, False)

    direct = how == "inner" or (is_point and len(levels) == 1)
    probe = _spread(left, lb, sizes, False, is_point)
    keys = ["_cx", "_cy"] + (["_lvl"] if len(levels) > 1 else [])
    if len(levels) == 1:
        probe, right = probe.drop("_lvl"), right.drop("_lvl")
    probe, right, keys = _salted(probe, right, keys, hot_rows, force_salt)
    hidden = ["_cx", "_cy", "_lvl", "_salt"]

    meet = (lb[0] <= rx1) & (lb[2] >= rx0) & (lb[1] <= ry1) & (lb[3] >= ry0)
    r_keys = {k: f"_r{k}" for k in keys}
    right = right.withColumnsRenamed(r_keys)
    if merge:
        right = right.hint("merge")
    cond = meet
    for k in keys:
        cond = cond & (F.col(k) == F.col(r_keys[k]))
    if not is_point:
        size = F.lit(float(sizes[0]))
        if len(levels) > 1:
            size = F.get(F.array(*[F.lit(float(s)) for s in sizes]), F.col("_lvl"))
        cond = cond & (F.col("_cx") == _floor(F.greatest(lb[0].cast("double"), rx0), size)) \
            & (F.col("_cy") == _floor(F.greatest(lb[1].cast("double"), ry0), size))
    if on is not None:
        cond = cond & (on() if callable(on) else on)
    drop = hidden + list(r_keys.values()) + names
    if direct:
        return probe.join(right, cond, how).drop(*drop)
    if key is None:
        raise ValueError("a semi or anti join of boxes needs the left key")
    hits = probe.join(right, cond, "inner").select(*key).distinct()
    return left.join(hits.hint("merge") if merge else hits, key, how)


def boxes_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Open overlap of half-open rectangles."""
    a, b = [_c(v) for v in (ax0, ay0, ax1, ay1)], [_c(v) for v in (bx0, by0, bx1, by1)]
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def explode_cells(df: DataFrame, box: Box, size: float, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """One row per grid cell a box touches."""
    b = [_c(v) for v in box]
    s = F.lit(float(size))
    return (df.withColumn(cx, F.explode(F.sequence(_floor(b[0], s), _floor(b[2], s))))
              .withColumn(cy, F.explode(F.sequence(_floor(b[1], s), _floor(b[3], s)))))
