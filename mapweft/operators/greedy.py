"""First-come-first-served selections, decided in parallel.

A sequential scan accepts an item unless it conflicts with an accepted one.
The same set results from rounds: an item with no better undecided rival is
decided, its losers are dropped, and the rest wait for the next round. Rounds go on
until nothing is open, however many they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import cut


def spaced_points(points: DataFrame, apart: float, key: str = "id", rank: str = "rank", x: str = "x", y: str = "y",
                  metric: str = "axis", block: int = 256, deep: int = 16) -> DataFrame:
    """Points kept by walking them in rank order and dropping any too near a kept one.

    `metric` "axis" drops when both axis distances are below `apart`;
    "euclid" when the straight distance is. A round walks blocks of `block` x `block` grid cells
    in rank order, over the best `deep` points of each cell, so chains inside a block are
    settled at once and a pile of equal points costs few rows. A point with an undecided better
    one around it waits; the blocks shift between rounds.
    """
    if metric == "axis":
        side, span = apart, 1
    else:
        side, span = apart / 2.0**0.5, 2
    dx, dy = F.abs(F.col(x) - F.col("_ax")), F.abs(F.col(y) - F.col("_ay"))
    near = (dx < apart) & (dy < apart) if metric == "axis" else (dx * dx + dy * dy < apart * apart)
    # Points in one cell always exclude each other: the side is scaled down a hair so that stays true of floats.
    side *= 1 - 1e-9
    open_pts = cut(points.select(key, rank, x, y).withColumn("_cx", F.floor(F.col(x) / side))
                   .withColumn("_cy", F.floor(F.col(y) / side)))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"))
                        for i in range(-span, span + 1) for j in range(-span, span + 1)])
    around = [(i, j) for i in range(-span, span + 1) for j in range(-span, span + 1)]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([rank, key])
        taken, waits, keep = {}, set(), []
        for px, py, cx, cy, sure in zip(pdf[x].to_numpy(), pdf[y].to_numpy(), pdf["_cx"].to_numpy(), pdf["_cy"].to_numpy(), pdf["_sure"].to_numpy()):
            cells = [(cx + i, cy + j) for i, j in around] if sure else []
            gaps = [(abs(px - t[0]), abs(py - t[1])) for t in map(taken.get, cells) if t is not None]
            lost = any(gx < apart and gy < apart if metric == "axis" else gx * gx + gy * gy < apart * apart for gx, gy in gaps)
            won = bool(sure) and not lost and waits.isdisjoint(cells)
            if won:
                taken[cx, cy] = (px, py)
            elif not lost:
                waits.add((cx, cy))
            keep.append(won)
        return pdf.loc[keep, [key, x, y, "_cx", "_cy"]].rename(columns={x: "_ax", y: "_ay"})

    kinds = {f.name: f.dataType.simpleString() for f in open_pts.schema}
    out = f"`{key}` {kinds[key]}, _ax {kinds[x]}, _ay {kinds[y]}, _cx long, _cy long"
    in_cell = Window.partitionBy("_cx", "_cy").orderBy(rank, key)
    kept, turn = None, 0
    while not open_pts.isEmpty():
        shift = block // 2 * (turn % 2)

        def home(i: int, j: int):
            return F.struct(F.floor((F.col("_cx") + i + shift) / block).alias("bx"), F.floor((F.col("_cy") + j + shift) / block).alias("by"))

        # The last row of a deep cell, and the rows next to a block, only say that something is undecided there.
        best = open_pts.withColumn("_n", F.row_number().over(in_cell)).where(F.col("_n") <= deep + 1)
        dealt = best.withColumn("_own", home(0, 0)).withColumn("_k", F.explode(F.array_distinct(F.array(*[home(i, j) for i, j in around]))))
        won = cut(dealt.select(key, rank, x, y, "_cx", "_cy", ((F.col("_n") <= deep) & (F.col("_k") == F.col("_own"))).alias("_sure"), "_k.bx", "_k.by")
                  .groupBy("bx", "by").applyInPandas(walk, out))
        if won.isEmpty():
            raise RuntimeError("selection: a round decided nothing")
        kept = won if kept is None else kept.union(won)
        reach = (won.select("_ax", "_ay", F.col("_cx").alias("_wx"), F.col("_cy").alias("_wy"), F.explode(offsets).alias("o"))
                 .select("_ax", "_ay", (F.col("_wx") + F.col("o.i")).alias("_wx"), (F.col("_wy") + F.col("o.j")).alias("_wy")))
        hit = (F.col("_cx") == F.col("_wx")) & (F.col("_cy") == F.col("_wy")) & near
        open_pts = cut(open_pts.join(reach, hit, "left_anti"))
        turn += 1
    if kept is None:
        return points.limit(0)
    return points.join(kept.select(key), key, "left_semi")


def first_come(items: DataFrame, rivals: DataFrame, key: str = "id") -> DataFrame:
    """Items kept when each is refused only by an accepted better rival.

    `rivals` holds (better, worse) key pairs. Returns the accepted keys.
    """
    edges = cut(rivals.select("better", "worse"))
    nodes = cut(edges.select(F.col("better").alias(key)).union(edges.select("worse")).distinct())
    free = items.select(key).join(nodes, key, "left_anti")
    kept = [free]
    while not nodes.isEmpty():
        blocked = edges.select(F.col("worse").alias(key)).distinct()
        ready = cut(nodes.join(blocked, key, "left_anti"))
        if ready.isEmpty():
            raise RuntimeError("selection: a round decided nothing")
        kept.append(ready)
        lost = edges.join(ready.withColumnRenamed(key, "better"), "better", "left_semi").select(F.col("worse").alias(key))
        nodes = cut(nodes.join(ready.union(lost).distinct(), key, "left_anti"))
        edges = cut(edges.join(nodes.withColumnRenamed(key, "better"), "better", "left_semi")
                    .join(nodes.withColumnRenamed(key, "worse"), "worse", "left_semi"))
    out = kept[0]
    for part in kept[1:]:
        out = out.union(part)
    return out
