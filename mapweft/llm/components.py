"""Connected components of links between rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.session import release, store

# Edges that one task contracts by itself before tasks exchange anything.
TASK_EDGES = 200_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The same connections as stars: each endpoint of this task's edges with its smallest id."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    yield pd.DataFrame({"a": [find(x) for x in parent], "b": list(parent)}, dtype="int64")


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every endpoint; the component is the smallest id in reach.

    Tasks of a bounded number of edges first turn their own into stars. Then each round hooks every label to its smallest neighbour, follows the hooks to their
    roots, and contracts the edges. Labels without smaller neighbours stay; every other
    one merges, so the number of labels shrinks at least by half wherever edges are left.
    A hub's minimum is taken with partial aggregation, and joins on a hub meet a
    stored side, so that a skewed join can be split at run time. Tables of a round are
    stored, not checkpointed: a checkpoint keeps the guess of its size, a join multiplies the
    guesses of its sides, and after some rounds such a number alone fills the driver.
    """
    ends = store(edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")))
    tasks = ends.count() // TASK_EDGES + 1
    state = store(ends.repartition(tasks).mapInPandas(_forest, "a long, b long").distinct())
    labels = store(state.select(F.col("b").alias("id")).distinct().withColumn("component", F.col("id")))
    release(ends)
    held, state = state, state.where("a <> b")
    while not state.isEmpty():
        both = state.union(state.select(F.col("b"), F.col("a")))
        roots = _follow(store(both.groupBy(F.col("a").alias("label")).agg(F.min("b").alias("low")).select("label", F.least("label", "low").alias("root"))))
        last = labels, held, roots
        labels = store(_renamed(labels, roots, "component"))
        held = state = store(_renamed(_renamed(state, roots, "a"), roots, "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(*last)
    return labels


def _renamed(df: DataFrame, roots: DataFrame, column: str) -> DataFrame:
    """Replace a column's labels by their roots."""
    to = roots.select(F.col("label").alias("_label"), F.col("root").alias("_root"))
    return df.join(to, F.col(column) == F.col("_label"), "left").withColumn(column, F.coalesce("_root", column)).drop("_label", "_root")


def _follow(roots: DataFrame) -> DataFrame:
    """Point every label of a stored table at the end of its chain of hooks; the chain's length halves twice a round."""
    while True:
        once = roots.join(roots.select(F.col("label").alias("_l"), F.col("root").alias("_r")), F.col("root") == F.col("_l")).select("label", "root", F.col("_r").alias("next"))
        twice = once.join(roots.select(F.col("label").alias("_l"), F.col("root").alias("_r")), F.col("next") == F.col("_l"))
        moved = store(twice.select("label", F.col("_r").alias("root"), (F.col("root") != F.col("_r")).alias("moved")))
        release(roots)
        roots = moved
        if moved.where("moved").isEmpty():
            return roots
