"""Near-duplicate vectors: tiles compared along principal axes, leading ones first."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweft.llm.components import components
from mapweft.llm.prefix import with_prefix
from mapweft.session import cut

BLOCK = 4096  # rows that travel together, at least
MOST = 65_536  # and at most: what a task of two blocks holds
TILE = 1024  # rows compared at once
STAGES = (8, 24)  # leading axes after which the bound is tested
SLACK = 1e-9  # room for rounding in a bound; the last test is exact


def _units(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    top = np.abs(raw).max(axis=1, keepdims=True)  # no overflow in the squares
    scaled = raw / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes of the unit vectors' second moments, the widest first.

    Each task sums its outer products; the sums of dims x dims numbers meet by aggregation.
    """

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for batch in batches:
            units = _units(_matrix(batch["vector"], dims))
            total += units.T @ units
        yield pd.DataFrame({"cell": np.arange(dims * dims), "value": total.ravel()})

    sums = vectors.select("vector").mapInPandas(moments, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
    square = np.zeros(dims * dims)
    square[sums["cell"]] = sums["value"]
    square = square.reshape(dims, dims)
    return np.linalg.eigh((square + square.T) / 2)[1][:, ::-1]


def _matrix(column: pd.Series, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    out = np.zeros((len(column), dims))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def compare(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of unit vectors whose cosine reaches the threshold, tile by tile.

    Along the principal axes the leading products are summed first; what the other axes
    can add is at most the product of the two suffix norms. A tile, and then each pair,
    is left as soon as sum and bound together cannot reach the threshold.
    """
    ra, rb = a @ axes, b @ axes
    stops = [s for s in STAGES if s < ra.shape[1]]
    rest = lambda r, s: np.sqrt(np.maximum((r[:, s:] ** 2).sum(axis=1), 0))
    tails = [(rest(ra, s), rest(rb, s)) for s in stops]
    for i0 in range(0, len(a), TILE):
        for j0 in range(i0 if same else 0, len(b), TILE):
            i1, j1 = min(i0 + TILE, len(a)), min(j0 + TILE, len(b))
            if stops:
                s = stops[0]
                left = np.column_stack([ra[i0:i1, :s], tails[0][0][i0:i1]])
                right = np.column_stack([rb[j0:j1, :s], tails[0][1][j0:j1]])
                i, j = np.nonzero(left @ right.T >= threshold - SLACK)
            else:
                i, j = np.nonzero(np.ones((i1 - i0, j1 - j0), bool))
            i, j = i + i0, j + j0
            if same and i0 == j0:
                i, j = i[i < j], j[i < j]
            for k, s in enumerate(stops[1:], 1):
                if not i.size:
                    break
                able = np.einsum("ij,ij->i", ra[i, :s], rb[j, :s]) + tails[k][0][i] * tails[k][1][j] >= threshold - SLACK
                i, j = i[able], j[able]
            if i.size:
                links = np.einsum("ij,ij->i", a[i], b[j]) >= threshold
                if links.any():
                    yield i[links], j[links]


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the labels of linked places; a label is the smallest place of its set."""
    while True:
        x, y = label[i], label[j]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def link_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Links between all vectors by cosine, and their components.

    Equal vectors are first counted as one, under a number of their own. The distinct ones
    are ordered by their angle to the widest axis and dealt into blocks; two vectors differ
    in that angle by no more than they do from each other, so a vector is sent to another
    block only if its angle is near enough to that block's. Two blocks meet in one task,
    which counts links and returns for each linked vector the smallest number in its local
    component, so that a pile of n near-equal vectors gives rows in the order of n, not of
    its pairs. There are as many blocks as keep the tasks busy, and no more until they
    reach their greatest size, since each vector may be sent once a block.

    Returns vec_id, n_links, component_id and kept, a row for each input row. Vectors
    that are null, empty or zero, or hold null or non-finite components, link with
    nothing; so do rows with a null id, and vectors of different lengths with each other.
    Repeated rows are vectors of their own, and different vectors may share an id: they keep
    their own links. A cosine that rounds to the threshold or more is a link. Empty input:
    no rows. Other columns are not carried.
    """
    frame = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    zero = F.lit(0).cast("double")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(F.col("vec_id").isNotNull() & ~odd & (F.aggregate("vector", zero, lambda s, x: F.greatest(s, F.abs(x).cast("double"))) > 0), F.lit(False))
    frame = frame.withColumn("vector", F.when(sound, F.col("vector")))
    single = cut(
        frame.where("vector IS NOT NULL").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("key", F.monotonically_increasing_id())
    )
    n, dims = single.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    if not n:
        return frame.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    axes = principal_axes(single, dims)
    first_axis = axes[:, 0]

    @F.pandas_udf("double")
    def turned(column: pd.Series) -> pd.Series:
        return pd.Series(np.arccos(np.clip(_units(_matrix(column, dims)) @ first_axis, -1, 1)))

    placed = with_prefix(single.withColumn("angle", turned("vector")), ["angle", "key"], "copies", "rank", "_ignored")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-n // MOST), min(-(-n // BLOCK), math.ceil(2 * math.sqrt(parts))))
    placed = cut(placed.withColumn("block", F.floor(F.col("rank") * blocks / n).cast("int")))
    # Least and greatest angle of each block: both ascend with the block.
    edges = placed.groupBy("block").agg(F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("block").collect()
    names, lows, highs = (np.array([e[i] for e in edges]) for i in range(3))
    reach = math.acos(max(-1.0, min(1.0, threshold))) + 1e-6

    @F.pandas_udf("array<int>")
    def within_reach(angles: pd.Series) -> pd.Series:
        first = np.searchsorted(highs, angles.to_numpy() - reach)
        stop = np.searchsorted(lows, angles.to_numpy() + reach, "right")
        return pd.Series([names[a:b].tolist() for a, b in zip(first, stop, strict=True)])

    met = placed.select("key", "copies", "vector", "block", F.explode(within_reach("angle")).alias("other")).select(
        "key", "copies", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "key"], kind="stable")
        keys, copies = rows["key"].to_numpy(np.int64), rows["copies"].to_numpy(np.int64)
        lens = rows["vector"].map(len).to_numpy()
        units = _units(_matrix(rows["vector"], dims))
        cut_at = int((rows["block"] == key[0]).sum())
        same = key[0] == key[1]
        a, b, shift = (units, units, 0) if same else (units[:cut_at], units[cut_at:], cut_at)
        links, label = np.zeros(len(keys), np.int64), np.arange(len(keys))
        order = np.argsort(keys, kind="stable")  # labels are places in the order of keys
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        for i, j in compare(a, b, axes, threshold, same):
            j = j + shift
            if lens.min() != lens.max():
                i, j = i[lens[i] == lens[j]], j[lens[i] == lens[j]]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            label = join_labels(label, place[i], place[j])
        some = np.flatnonzero(links)
        return pd.DataFrame({"key": keys[some], "links": links[some], "low_key": keys[order[label[place[some]]]]})

    found = cut(met.groupBy("low", "high").applyInPandas(meet, "key long, links long, low_key long"))
    linked = components(found, "key", "low_key").withColumnRenamed("id", "key").withColumnRenamed("component", "group")
    lowest = linked.join(single.select("key", "rep"), "key").groupBy("group").agg(F.min("rep").alias("component"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = cut(
        single.join(counts, "key", "left").join(linked.join(lowest, "group").select("key", "component"), "key", "left")
        .select("vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    return frame.join(known, "vector", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").cast("long").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"),
    )
