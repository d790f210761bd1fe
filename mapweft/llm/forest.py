"""Approximate nearest neighbours: a forest of sorted hash strings, searched by prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweft.session import cut

TREES = 32
BITS = 62  # length of a hash string
MISS = 0.05  # largest chance to miss a vector as near as the last one wanted
FIRST = 64  # candidates, over all trees, at which the first descent stops
SHARD_ROWS = 262_144  # most vectors of one forest: bounds the memory of its task
LEAST_ROWS = 256  # below this a forest is not split to occupy more tasks
SCOUTS = 16  # forests that a query visits before its bound is known
SEED = 20


def planes_of(dims: int, trees: int = TREES, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """Normals of the planes whose sides spell the hash strings: (trees, dims + 1, bits)."""
    return np.random.default_rng([seed, dims]).standard_normal((trees, dims + 1, bits))


def _spell(units: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Hash strings as whole numbers, the first bit highest."""
    bits = planes.shape[1]
    out = np.zeros(len(units), np.int64)
    for at in range(0, len(units), 16_384):
        sides = units[at : at + 16_384] @ planes >= 0
        out[at : at + 16_384] = sides @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))
    return out


class Forest:
    """Sorted hash strings of a bounded number of vectors, one array a tree.

    Vectors are divided by the greatest norm and lifted to the unit sphere by one more
    coordinate, queries have 0 there: then the cosine orders as the inner product does.
    Equal vectors are one entry with the `wanted` smallest of their ids, since no answer
    can hold more of them.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, planes: np.ndarray, wanted: int):
        order = np.lexsort((rows, ids))
        ids, rows, vectors = ids[order], rows[order], vectors[order]
        first, group = _distinct(vectors)
        by_group = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=len(first))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(len(group)) - np.repeat(starts, sizes)
        by_group = by_group[place < wanted]
        self.ids, self.rows = ids[by_group], rows[by_group]
        self.starts = np.concatenate([[0], np.cumsum(np.minimum(sizes, wanted))])
        self.vectors = np.ascontiguousarray(vectors[first])
        self.planes, self.wanted = planes, wanted
        norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.top = float(norms.max())
        units = self.vectors / self.top
        units = np.column_stack([units, np.sqrt(np.maximum(1 - (units**2).sum(axis=1), 0))])
        spelled = [_spell(units, p) for p in planes]
        self.order = [np.argsort(s, kind="stable") for s in spelled]
        self.sorted = [s[o] for s, o in zip(spelled, self.order, strict=True)]

    def _spans(self, hashes: list[np.ndarray], depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the entries lie that share the first `depth` bits with each query: (trees, queries) twice."""
        bits = self.planes.shape[2]
        shift = (bits - depth).astype(np.int64)
        low = [(h >> shift) << shift for h in hashes]
        begin = np.array([np.searchsorted(s, x, "left") for s, x in zip(self.sorted, low, strict=True)])
        end = np.array([np.searchsorted(s, x + (np.int64(1) << shift) - 1, "right") for s, x in zip(self.sorted, low, strict=True)])
        return begin, end

    def descend(self, hashes: list[np.ndarray], least: int) -> np.ndarray:
        """The greatest depth at which all trees together hold `least` candidates of each query.

        The descent in a tree ends at the longest prefix that any entry shares; from the
        longest of all trees, they ascend together, one bit at a time.
        """
        bits = self.planes.shape[2]
        longest = np.zeros(len(hashes[0]), np.int64)
        for tree, h in zip(self.sorted, hashes, strict=True):
            at = np.searchsorted(tree, h)
            for near in (np.maximum(at - 1, 0), np.minimum(at, len(tree) - 1)):
                differ = h ^ tree[near]
                # float64 rounds up to the next power of two at most: a bit less is shared then, never lost.
                longest = np.maximum(longest, bits - np.ceil(np.log2(differ + 1.0)).astype(np.int64))
        depth = longest.copy()
        able = np.arange(len(depth))
        while able.size:
            begin, end = self._spans([h[able] for h in hashes], depth[able])
            able = able[((end - begin).sum(axis=0) < least) & (depth[able] > 0)]
            depth[able] -= 1
        return depth

    def depth_for(self, bounds: np.ndarray, norms: np.ndarray, miss: float) -> np.ndarray:
        """The depth at which a vector of score `bound` is missed by all trees with chance `miss` at most.

        A plane parts two unit vectors with chance angle / pi, so they share a prefix of
        d bits in one of t trees with chance 1 - (1 - p^d)^t, where p = 1 - angle / pi.
        """
        bits, trees = self.planes.shape[2], self.planes.shape[0]
        cosine = np.clip(bounds / (norms * self.top), -1, 1)
        p = np.clip(1 - np.arccos(cosine) / np.pi, 1e-12, 1 - 1e-12)
        return np.clip(np.floor(np.log(1 - miss ** (1 / trees)) / np.log(p)), 0, bits).astype(np.int64)

    def search(self, queries: np.ndarray, bounds: np.ndarray | None, first: int, miss: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each query the best `wanted` candidates: (ids, rows, scores), best first, ties by id."""
        norms = np.sqrt((queries**2).sum(axis=1))
        units = np.column_stack([queries / norms[:, None], np.zeros(len(queries))])
        hashes = [_spell(units, p) for p in self.planes]
        depth = self.descend(hashes, first)
        if bounds is not None:
            depth = np.minimum(depth, self.depth_for(bounds, norms, miss))
        begin, end = self._spans(hashes, depth)
        begin, end = begin.T.tolist(), end.T.tolist()
        met = np.zeros(len(self.vectors), bool)
        for query, lows, highs in zip(queries, begin, end, strict=True):
            met[:] = False
            for order, low, high in zip(self.order, lows, highs, strict=True):
                if low < high:
                    met[order[low:high]] = True
            some = np.flatnonzero(met)
            if len(some) > self.wanted:
                rough = self.vectors[some] @ query
                last = np.partition(rough, len(rough) - self.wanted)[len(rough) - self.wanted]
                some = some[rough >= last - 1e-9 * (1 + abs(last))]
            # Summed in one way for every place of a row, so that equal vectors have equal scores.
            exact = (self.vectors[some] * query).sum(axis=1)
            sizes = self.starts[some + 1] - self.starts[some]
            members = np.repeat(self.starts[some] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            scores = np.repeat(exact, sizes)
            best = np.lexsort((self.rows[members], self.ids[members], -scores))[: self.wanted]
            yield self.ids[members[best]], self.rows[members[best]], scores[best]


def _distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each distinct row, and the number of every row's distinct one."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    _, first, group = np.unique(raw, return_index=True, return_inverse=True)
    return first, group.ravel()


def _walk(k: int, trees: int, miss: float, first: int, seed: int):
    """A function over the rows of shards, each shard's vectors first, then its queries.

    Only the vectors of one shard are held; its queries stream by.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, forest = None, [], None
        for batch in batches:
            change = (batch[["dims", "shard", "asks"]] != batch[["dims", "shard", "asks"]].shift()).any(axis=1).cumsum()
            for _, rows in batch.groupby(change, sort=False):
                now = (int(rows["dims"].iat[0]), int(rows["shard"].iat[0]))
                if now != key:
                    key, held, forest = now, [], None
                vectors = np.vstack(rows["vector"].to_list()).astype(np.float64)
                if not rows["asks"].iat[0]:
                    held.append((rows["vec_id"].to_numpy(np.int64), rows["row"].to_numpy(np.int64), vectors))
                    continue
                if not held and forest is None:
                    continue
                if forest is None:
                    forest = Forest(*[np.concatenate(x) for x in zip(*held, strict=True)], planes_of(now[0], trees, BITS, seed), k + 1)
                    held = []
                # Equal query vectors are searched once.
                bounds = rows["bound"].to_numpy(np.float64)
                one, group = _distinct(np.column_stack([vectors, bounds]))
                asked = np.argsort(group, kind="stable")
                at = np.searchsorted(group[asked], np.arange(len(one) + 1))
                known = None if np.isposinf(bounds).all() else bounds[one]
                out: list[tuple] = []
                for g, (ids, own, scores) in enumerate(forest.search(vectors[one], known, first, miss)):
                    if known is not None:  # what is below the bound cannot be among the k best
                        able = scores >= known[g]
                        ids, own, scores = ids[able], own[able], scores[able]
                    for i in asked[at[g] : at[g + 1]]:
                        others = own != rows["row"].iat[i]
                        out.append((rows["row"].iat[i], rows["vec_id"].iat[i], ids[others][:k], own[others][:k], scores[others][:k]))
                lens = [len(o[2]) for o in out]
                yield pd.DataFrame({
                    "asker": np.repeat([o[0] for o in out], lens), "query_id": np.repeat([o[1] for o in out], lens),
                    "vec_id": np.concatenate([o[2] for o in out]), "row": np.concatenate([o[3] for o in out]), "score": np.concatenate([o[4] for o in out]),
                })

    return search


def nearest(
    vectors: DataFrame, queries: Column, k: int = 20, trees: int = TREES, miss: float = MISS, first: int = FIRST, seed: int = SEED,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """The k vectors of greatest inner product with each query, among all rows but its own.

    `queries` is a condition on the input's rows. The rows are dealt into shards of bounded
    size, as many as there are tasks to fill until they reach that size; a shard's forest
    lies sorted in one task and all queries stream past it. First each query descends to
    its longest prefixes in up to SCOUTS shards, and their trees ascend together until they
    hold `first` candidates; the k-th best of these is a bound for the answer. Then it
    visits every shard, and the trees ascend to the depth at which a vector as good as
    that bound is missed by all of them with chance `miss` at most; only what reaches the
    bound is returned. Near neighbours are found deep in the trees; where vectors are
    hardly nearer than chance, the ascent goes far up, and at the root every row is a
    candidate: there is no cap on candidates.

    Returns query_id, rank (from 1), vec_id and score (inner product in double precision),
    fewer than k rows if there are fewer candidates; ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components take no part,
    nor do rows with a null id; vectors of different lengths never meet. Repeated rows are
    rows of their own: each is a candidate of the others. Empty input: no rows. Other
    columns are not carried.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = ~odd & F.exists("vector", lambda x: x != 0)
    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    frame = cut(
        narrow.where("vec_id IS NOT NULL AND vector IS NOT NULL").where(sound)
        .withColumn("row", F.monotonically_increasing_id()).withColumn("dims", F.size("vector"))
    )
    n = frame.count()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, -(-n // SHARD_ROWS), min(parts, -(-n // LEAST_ROWS)))
    columns = ["dims", "shard", "asks", "row", "vec_id", "vector", "bound"]
    missing = F.lit(float("inf"))
    members = frame.withColumns({"shard": F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"), "asks": F.lit(False), "bound": missing}).select(columns)
    asking = frame.where("asks")
    asked = asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # Scouts start anywhere and go on to the next shards.
    some = F.sequence(F.lit(0), F.lit(min(SCOUTS, shards) - 1))
    scouts = asking.withColumn("_step", F.explode(some)).withColumn("shard", F.pmod(F.xxhash64("row", F.lit(seed)) + F.col("_step"), F.lit(shards)).cast("int"))
    schema = "asker long, query_id long, vec_id long, row long, score double"

    def visit(asking: DataFrame) -> DataFrame:
        met = members.unionByName(asking.select(columns)).repartitionById(shards, "shard").sortWithinPartitions("dims", "shard", "asks", "row")
        found = met.mapInPandas(_walk(k, trees, miss, first, seed), schema)
        best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    bounds = visit(scouts.withColumn("bound", missing)).where(F.col("rank") == k).select(F.col("asker").alias("row"), F.col("score").alias("bound"))
    # Without k candidates so far there is no bound, and the ascent goes to the root.
    again = asked.join(cut(bounds), "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
    return visit(again).select("query_id", "rank", "vec_id", "score")
